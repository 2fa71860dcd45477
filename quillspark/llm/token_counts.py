"""Edit-aware token counts.

A byte-pair tokenizer first cuts a text into pre-tokens and encodes each by itself, so a text's count is the sum over its
pre-tokens. Each document keeps a segment tree over them: leaves hold the tokens (and characters) of ``leaf`` pre-tokens,
inner nodes the sums of ``fan`` children. An edit finds its leaves through the tree, cuts and encodes again only from a few
pre-tokens before the edit up to the place where the new cut meets the old one, and updates the sums above.
Trees are kept as a table (``grow``); a later count (``recount``) reads them, and the texts of edited documents alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import match_spans, saved, small_batches

#: Fixed value: the pre-token pattern of the byte-level vocabularies (public).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 200_000
LEAF = 64


class Counter:
    """Tokens of a pre-token; the counts of short ones are remembered, up to MEMO of them at a time."""

    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 32:
                if len(self.known) >= MEMO:
                    self.known.clear()
                self.known[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        got = list(map(self.known.get, pieces))
        if None in got:
            got = [self(p) if n is None else n for p, n in zip(pieces, got, strict=True)]
        return got


@lru_cache(maxsize=2)
def counter_of(vocabulary: str) -> Counter:
    """One counter for all tasks of a worker: its vocabulary and memory are tens of megabytes."""
    return Counter(vocabulary)


class Tree:
    """Segment tree over a text's pre-tokens: leaves are lists of (characters, tokens); inner levels hold sums."""

    def __init__(self, lengths: list[int], counts: list[int], leaf: int = LEAF, fan: int = 16):
        self.leaf, self.fan = leaf, fan
        self.leaves = [(lengths[i : i + leaf], counts[i : i + leaf]) for i in range(0, len(lengths), leaf)] or [([], [])]
        self.levels: list[list[tuple[int, int]]] = []
        self._build()

    def _build(self) -> None:
        level = [(sum(a), sum(b)) for a, b in self.leaves]
        self.levels = [level]
        while len(level) > 1:
            level = [tuple(map(sum, zip(*level[i : i + self.fan], strict=True))) for i in range(0, len(level), self.fan)]
            self.levels.append(level)

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1]

    @property
    def chars(self) -> int:
        return self.levels[-1][0][0]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character ``at`` (the last one for the end), and where that leaf starts."""
        node, start = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= self.fan
            last = min(node + self.fan, len(level)) - 1
            while node < last and start + level[node][0] <= at:
                start += level[node][0]
                node += 1
        return node, start

    def replace(self, a: int, b: int, lengths: list[int], counts: list[int]) -> None:
        """Put new pre-tokens in place of leaves ``a`` to ``b`` (exclusive); sums above are updated along the path alone
        unless the number of leaves changes."""
        new = [(lengths[i : i + 2 * self.leaf], counts[i : i + 2 * self.leaf]) for i in range(0, len(lengths), 2 * self.leaf)] or [([], [])]
        same = len(new) == b - a
        self.leaves[a:b] = new
        if not same:
            self._build()
            return
        for i, (x, y) in enumerate(new, a):
            self.levels[0][i] = (sum(x), sum(y))
        lo, hi = a, b - 1
        for d in range(1, len(self.levels)):
            lo, hi = lo // self.fan, hi // self.fan
            below = self.levels[d - 1]
            for i in range(lo, hi + 1):
                self.levels[d][i] = tuple(map(sum, zip(*below[i * self.fan : (i + 1) * self.fan], strict=True)))


def apply_edit(text: str, tree: Tree, start: int, end: int, new: str, counter: Counter, context: int = 3) -> tuple[str, int]:
    """The edited text and the number of pre-tokens that were encoded again; ``tree`` becomes the edited text's.

    The new cut starts ``context`` pre-tokens before the edit's first leaf position and may stop once one of its borders,
    at least one old pre-token past the edit, is an old border: a pre-token's extent depends on nothing before it.
    """
    after = text[:start] + new + text[end:]
    first, begin = tree.find(max(0, start - 1))
    last = first + 1
    old = list(zip(*tree.leaves[first], strict=True))
    at, i = begin, 0
    while i < len(old) and at + old[i][0] < start:
        at += old[i][0]
        i += 1
    if i < context and first:
        first -= 1
        before = list(zip(*tree.leaves[first], strict=True))
        begin -= tree.levels[0][first][0]
        old, i = before + old, i + len(before)
    head, tail = old[: max(0, i - context)], old[max(0, i - context) :]
    begin += sum(n for n, _ in head)
    shift, pieces, here, border, k = len(new) - (end - start), [], begin, begin, 0
    for m in counter.cut.finditer(after, begin):
        if here >= start + len(new):  # past the edit: is this border of the new cut one of the old cut?
            while border + shift < here:
                if k == len(tail):
                    if last == len(tree.leaves):
                        break
                    tail += zip(*tree.leaves[last], strict=True)
                    last += 1
                    continue
                border += tail[k][0]
                k += 1
            if border + shift == here and border >= end:
                break
        pieces.append(m.group())
        here = m.end()
    else:
        k, last = len(tail), len(tree.leaves)
    fresh = list(zip(map(len, pieces), counter.counts(pieces), strict=True))
    whole = head + fresh + tail[k:]
    tree.replace(first, last, [n for n, _ in whole], [c for _, c in whole])
    return after, len(pieces)


TREE = ["n_chars", "n_pretokens", "n_tokens", "segments"]
KEPT = "c0 {id}, text_key long, tree long, n_chars long, n_pretokens long, n_tokens long, segments binary"
NAMES = ["n_chars", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_chars_after", "n_tokens_after"]
EDITS = "array<struct<start:int,end:int,new:string>>"


def stored(leaves: list[int], chars: list[int], tokens: list[int]) -> bytes:
    """How many leaves, pre-tokens of each, characters and tokens of each pre-token, in one byte each where all fit."""
    both = np.array([chars, tokens], np.uint32)
    narrow = both.size == 0 or int(both.max()) < 256
    return b"".join((bytes([narrow]), np.uint32(len(leaves)).tobytes(), np.array(leaves, np.uint32).tobytes(), both.astype(np.uint8 if narrow else np.uint32).tobytes()))


def kept(tree: Tree) -> bytes:
    """A tree as it is stored; sums above the leaves are not."""
    return stored([len(a) for a, _ in tree.leaves], [n for a, _ in tree.leaves for n in a], [n for _, b in tree.leaves for n in b])


def held(segments: bytes) -> Tree:
    """The tree that ``kept`` stored."""
    n = int(np.frombuffer(segments, np.uint32, 1, 1)[0])
    leaves = np.frombuffer(segments, np.uint32, n, 5).tolist()
    chars, tokens = np.frombuffer(segments, np.uint8 if segments[0] else np.uint32, -1, 5 + 4 * n).reshape(2, -1).tolist()
    tree, at = Tree([], []), 0
    tree.leaves = []
    for n in leaves:
        tree.leaves.append((chars[at : at + n], tokens[at : at + n]))
        at += n
    tree._build()
    return tree


def _grown(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, name = counter_of(vocabulary), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for text in batch.column(2):
                t = text.as_py() or ""
                pieces = counter.pieces(t)
                n, counts = len(pieces), counter.counts(pieces)
                leaves = [min(LEAF, n - i) for i in range(0, n, LEAF)] or [0]
                rows.append((name, len(t), n, sum(counts), stored(leaves, list(map(len, pieces)), counts)))
                name += 1
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["c0", "text_key", "tree", *TREE])

    return run


def settled(edits: list[dict | None], size: int) -> list[tuple[int, int, str]]:
    """The edits of a text of ``size`` code points that are applied, by place: offsets beyond the text are its ends, an end before its start
    is the start, a null replacement is empty; edits without a start or end, and those that begin before an earlier one ends, are left
    out (of two with one start the first listed is the earlier). Insertions at one place stand in the order given."""
    out, taken = [], 0
    known = [e for e in edits if e and e["start"] is not None and e["end"] is not None]
    for e in sorted(known, key=lambda e: min(max(e["start"], 0), size)):
        start = min(max(e["start"], 0), size)
        end = min(max(e["end"], start), size)
        if start >= taken:
            out.append((start, end, e["new"] or ""))
            taken = end
    return out


def _edited(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            rows = []
            for text, edits, segments in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                t, tree = text.as_py() or "", held(segments.as_py())
                again = n = 0
                for start, end, new in reversed(settled(edits.as_py(), len(t))):  # from the back: offsets are the original text's
                    t, got = apply_edit(t, tree, start, end, new, counter)
                    again, n = again + got, n + 1
                rows.append((n, again, len(t), tree.tokens, kept(tree)))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["tree", *NAMES[3:], "new_segments"])

    return run


def text_key(id_col: str, text_col: str) -> Column:
    """Names a text under its id: a kept tree serves only the text it was grown from."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull())


def grow(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The trees of all rows, to be kept as a table: id, text_key, tree (a number of its own), n_chars, n_pretokens, n_tokens,
    segments.

    ``vocabulary`` is the path of a ranks file, the same on every machine. This encodes every text in full, once.
    Defined cases: null and empty texts have a tree without pre-tokens; null ids and repeated rows have their trees one by
    one; an empty table gives no rows; other columns of the input are not read.
    """
    cols = small_batches(docs).select(F.col(id_col).alias("c0"), text_key(id_col, text_col).alias("text_key"), F.col(text_col).alias("text"))
    return cols.mapInArrow(_grown(vocabulary), KEPT.format(id=docs.schema[id_col].dataType.simpleString())).withColumnRenamed("c0", id_col)


def recount(docs: DataFrame, trees: DataFrame, vocabulary: str, edits: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``trees``, a stored table: its columns, then n_edits, n_reencoded (pre-tokens encoded for the edits),
    n_chars_after and n_tokens_after; segments are the edited text's.

    ``docs`` are the rows that ``trees`` were grown from, with ``edits``, an array column of (start, end, new): code points of the
    original text, end exclusive; ``settled`` says what becomes of overlapping ones and of offsets beyond the text. Only rows with edits are read and joined with their trees, and of their
    texts only the edited regions are encoded; of rows with equal id and text one row's edits count. The others keep their sums.
    """
    own = F.col(edits).cast(EDITS)
    touched = small_batches(docs).where(F.size(own) > 0).select(text_key(id_col, text_col).alias("own_key"), F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), own.alias("edits")).dropDuplicates(["own_id", "own_key"])
    stored = trees.select(F.col(id_col).alias("tree_id"), "text_key", "tree", "segments")
    met = touched.join(stored, touched["own_id"].eqNullSafe(stored["tree_id"]) & (F.col("own_key") == F.col("text_key"))).select("tree", "text", "edits", "segments")
    changed = saved(met.mapInArrow(_edited(vocabulary), f"tree long, {', '.join(f'{x} long' for x in NAMES[3:])}, new_segments binary"), "token-edits")
    both, none = trees.join(changed, "tree", "left"), F.lit(0).cast("long")
    after = {"segments": F.coalesce("new_segments", "segments"), "n_edits": F.coalesce("n_edits", none), "n_reencoded": F.coalesce("n_reencoded", none), "n_chars_after": F.coalesce("n_chars_after", "n_chars"), "n_tokens_after": F.coalesce("n_tokens_after", "n_tokens")}
    return both.select(id_col, "text_key", "tree", *TREE[:3], *(c.alias(x) for x, c in after.items()))


def count_tokens(docs: DataFrame, vocabulary: str, edits: str | None = None, id_col: str = "doc_id", text_col: str = "text", trees: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, n_chars, n_pretokens, n_tokens, n_edits, n_reencoded (pre-tokens encoded for the edits),
    n_chars_after, n_tokens_after.

    ``edits`` names an array column of (start, end, new): code points of the original text, end exclusive; ``settled`` says
    what becomes of overlapping ones and of offsets beyond the text.
    ``trees``: those that ``grow`` made of the same rows; without them they are grown and kept in the shared folder first.
    ``vocabulary`` is the path of a ranks file, the same on every machine.
    Defined cases: null and empty texts have no tokens; a null list of edits is an empty one; null ids and repeated rows
    are counted one by one; an empty table gives no rows; other columns of the input are not read.
    """
    trees = saved(grow(docs, vocabulary, id_col, text_col), "token-trees") if trees is None else trees
    rows = docs.select(F.col(id_col), F.col(text_col), (F.col(edits) if edits else F.lit(None)).cast(EDITS).alias("_edits"))
    return recount(rows, trees, vocabulary, "_edits", id_col, text_col).select(id_col, *NAMES)


def redactions(text_col: str = "text", pattern: str = r"[0-9]{3,}", new: str = "0") -> Column:
    """Edits that replace each run of digits, as a maker of clean copies would: an array column for ``count_tokens``. Null and empty
    texts have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.transform(match_spans(text, pattern), lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), F.lit(new).alias("new")))
    return F.when(text.rlike(pattern), spans.cast(EDITS)).otherwise(F.array().cast(EDITS))
