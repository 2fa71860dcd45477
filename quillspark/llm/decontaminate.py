"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units after numbers and names (capitalised words inside a sentence, runs of them as
one) turn into typed slots, all else into lower-case words without punctuation. A second template takes every capitalised
word as a word, so that copies in upper case or title case, where case tells no names, are found too. Windows of template tokens of the
benchmark are hash-joined with those of every document. Matches on one diagonal (document place minus item place) are
then checked slot by slot: a copy has the item's values, a re-parameterised copy maps each value of the item to one value
of its own and no two to the same; matches whose slots contradict each other are dropped.
Items without a window of mostly words in either template are looked for whole: their words, numbers and units in order.

Windows of documents pass a filter of a bounded size, made of all windows of the benchmark, before they are joined by hash;
the corpus is read once, however large the benchmark. Pairs of document and item come from the item's rarest windows alone:
what most items share (an instruction that opens all of them, say) makes no pairs. Each pair's matched windows carry the
values in their slots, so texts are not read again.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from .common import ODD, Filter, bounded_filter, mix, run_hashes, salted_join, saved, small_batches, string_blocks, tokens

#: Units that count as one after a number.
UNITS = "mm cm m km inch inches ft feet yard yards mile miles mg g kg lb lbs ton tons oz ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents pound pounds percent mph kmh w kw mw v a hz khz mhz ghz kb mb gb tb c f k degrees".split()

WORD, NUMBER, UNIT, NAME = range(4)
SLOT = mix(np.arange(11, 15, dtype=np.uint64) * np.uint64(ODD[4]))
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[[ord(x) for x in ".!?:\n"]] = True
POINT = np.zeros(256, bool)
POINT[[ord("."), ord(",")]] = True




def _fold() -> np.ndarray:
    """Lower case of the characters of two bytes, where it has two bytes as well."""
    out = np.arange(1 << 16, dtype=np.uint16)
    for cp in range(0x80, 0x800):
        b, low = chr(cp).encode(), chr(cp).lower().encode()
        if len(low) == 2:
            out[b[0] << 8 | b[1]] = low[0] << 8 | low[1]
    return out


FOLD = _fold()


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with characters of two bytes in lower case (A-Z and a-z have one hash value anyway)."""
    at = np.flatnonzero((data >= 0xC3) & (data <= 0xDF))
    if not len(at):
        return data
    data = data.copy()
    low = FOLD[data[at].astype(np.int32) << 8 | data[at + 1]]
    data[at], data[at + 1] = low >> 8, low & 0xFF
    return data


@dataclass
class Template:
    token: np.ndarray  # hash of each token: the word, or its slot's type
    kind: np.ndarray
    value: np.ndarray  # hash of what stands in the slot
    start: np.ndarray  # bytes in the block
    end: np.ndarray
    row: np.ndarray


_unit = b"".join(x.encode() + b" " for x in UNITS)
_u = np.frombuffer(_unit, np.uint8)
_s, _e, _ = tokens(_u, np.array([0, len(_u)]), ~ALNUM[_u])
UNIT_HASH = np.sort(run_hashes(_u, _s, _e, ~ALNUM[_u]))


def canonical(data: np.ndarray, off: np.ndarray) -> tuple[Template, Template]:
    """The template tokens of a block's rows: with names as slots, and with capitalised words as words."""
    gap = ~ALNUM[data]
    if len(data) > 2:  # 3.5 and 1,000 are one token
        inner = POINT[data[1:-1]] & DIGIT[data[:-2]] & DIGIT[data[2:]]
        gap[1:-1] &= ~inner
    s, e, n = tokens(data, off, gap)
    row = np.repeat(np.arange(len(off) - 1), n)
    value = run_hashes(lower(data), s, e, gap)
    if not len(s):
        none = Template(value, np.zeros(0, np.int8), value, s, e, row)
        return none, none
    opens = np.r_[True, row[1:] != row[:-1]]
    stops = np.r_[0, np.cumsum(STOP[data] & gap)]
    opens[1:] |= stops[s[1:]] > stops[e[:-1]]
    first = data[s]
    second = data[np.minimum(s + 1, len(data) - 1)]
    kind = np.zeros(len(s), np.int8)
    upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    kind[upper & ~opens] = NAME
    number = DIGIT[first]
    kind[number] = NUMBER
    after = np.r_[False, number[:-1] & ~opens[1:]]
    kind[after & np.isin(value, UNIT_HASH)] = UNIT
    plain = np.where(kind == NAME, WORD, kind).astype(np.int8)
    folded = Template(np.where(plain > 0, SLOT[plain], value), plain, value, s, e, row)
    again = np.r_[False, (kind[1:] == NAME) & (kind[:-1] == NAME) & (row[1:] == row[:-1])]
    keep = np.flatnonzero(~again)
    with np.errstate(over="ignore"):
        order = np.where(again, np.uint64(ODD[2]), np.uint64(1))
        joined = np.add.reduceat(value * order, keep)
    to = np.r_[keep[1:], len(s)] - 1
    kind = kind[keep]
    return Template(np.where(kind > 0, SLOT[kind], joined), kind, joined, s[keep], e[to], row[keep]), folded


def windows(t: Template, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``k`` tokens and its first token; windows with under ``least`` words (not slots) are left out."""
    n = len(t.token) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(ODD[0]) + t.token[i : n + i] * np.uint64(ODD[1])
    words = np.r_[0, np.cumsum(t.kind == WORD)]
    ok = (t.row[:n] == t.row[k - 1 :]) & (words[k:] - words[:-k] >= least)
    return mix(h)[ok], np.flatnonzero(ok)


TYPED, PLAIN, WHOLE = range(3)  # windows of the template with names, of the one without, and of values where neither has any


def _value_windows(t: Template, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` values within a row, and its first token."""
    m = len(t.value) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(m, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = h * np.uint64(ODD[0]) + t.value[i : m + i] * np.uint64(ODD[1])
    at = np.flatnonzero(t.row[:m] == t.row[n - 1 :])
    return mix(h)[at], at


def _named(h: np.ndarray, which: int) -> np.ndarray:
    """Windows of different kinds never meet."""
    return mix(h ^ np.uint64(ODD[which])).view(np.int64)


ITEMS = "item long, item_id {item}, which int, nth int, h long, n int, n_windows int, item_values binary, item_kinds binary"


def _items(k: int):
    """The windows of all items, one a row, with the values and kinds of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, to, data, off in string_blocks(batch.column(1)):
                typed, plain = canonical(data, off)
                found = []
                for which, t in ((TYPED, typed), (PLAIN, plain)):
                    h, at = windows(t, k, k // 2 + 1)
                    found.append((which, t, h, at, np.full(len(h), k)))
                covered = np.zeros(to - first, bool)
                for _, t, _, at, _ in found:
                    covered[t.row[at]] = True
                size = np.bincount(plain.row, minlength=to - first)
                for n in np.unique(np.minimum(size[~covered], k)).tolist():
                    if n:
                        h, at = _value_windows(plain, n)
                        own = ~covered[plain.row[at]] & (np.minimum(size[plain.row[at]], k) == n)
                        found.append((WHOLE, plain, h[own], at[own], np.full(int(own.sum()), n)))
                for which, t, h, at, n in found:
                    row = t.row[at]
                    total = np.bincount(row, minlength=to - first)
                    nth = at - np.searchsorted(t.row, row)
                    span = list(zip(at.tolist(), (at + n).tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(base + first + row), batch.column(0).slice(first, to - first).take(pa.array(row)), pa.array(np.full(len(h), which), pa.int32()), pa.array(nth, pa.int32()), pa.array(_named(h, which)), pa.array(n, pa.int32()), pa.array(total[row], pa.int32()),
                         pa.array([t.value[a:b].tobytes() for a, b in span], pa.binary()), pa.array([t.kind[a:b].tobytes() for a, b in span], pa.binary())],
                        ["item", "item_id", "which", "nth", "h", "n", "n_windows", "item_values", "item_kinds"],
                    )
            base += batch.num_rows

    return run


HITS = "row long, row_id {id}, which int, h long, at int, start int, end int, doc_values binary"


def _hits(k: int, sizes: list[int], known: Filter):
    """The windows of documents that items may have: their place in tokens and code points, and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, to, data, off in string_blocks(batch.column(1)):
                typed, plain = canonical(data, off)
                point = None
                for which, t, n in ((TYPED, typed, k), (PLAIN, plain, k), *((WHOLE, plain, n) for n in sizes)):
                    h, at = _value_windows(t, n) if which == WHOLE else windows(t, k, k // 2 + 1)
                    h = _named(h, which)
                    hit = known.passes(h) if len(h) else np.zeros(0, bool)
                    if not hit.any():
                        continue
                    h, at = h[hit], at[hit]
                    row = t.row[at]
                    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)] if point is None else point
                    start, end = point[t.start[at]] - point[off[row]], point[t.end[at + n - 1]] - point[off[row]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(base + first + row), batch.column(0).slice(first, to - first).take(pa.array(row)), pa.array(np.full(len(h), which), pa.int32()), pa.array(h), pa.array(at - np.searchsorted(t.row, row), pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([t.value[a : a + n].tobytes() for a in at.tolist()], pa.binary())],
                        ["row", "row_id", "which", "h", "at", "start", "end", "doc_values"],
                    )
            base += batch.num_rows

    return run


def agreement(pairs: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Of slot pairs (item's value, document's value): how many fit the most frequent one-to-one map, how many are equal, how many there are."""
    fit, used, of = 0, set(), defaultdict(Counter)
    for a, b in pairs:
        of[a][b] += 1
    for a, c in sorted(of.items(), key=lambda x: -max(x[1].values())):
        b, n = next(((b, n) for b, n in sorted(c.most_common(), key=lambda x: (-x[1], x[0] != a, x[0])) if b not in used), (None, 0))
        used.add(b)
        fit += n
    return fit, sum(a == b for a, b in pairs), len(pairs)


OUT = "row_id {id}, item_id {item}, n_windows int, n_matched int, coverage double, kind string, n_slots int, n_slots_fit int, start int, end int"


def _settled(coverage: float, run_words: int, consistency: float):
    """Of whole pairs of document and item, their matched windows: the pairs that hold, by diagonal and slot."""

    def pair(rows: np.ndarray, c: dict, values: tuple[list, list, list]) -> tuple | None:
        which, n, total = int(c["which"][rows[0]]), int(c["n"][rows[0]]), int(c["n_windows"][rows[0]])
        lines: dict[int, list[int]] = defaultdict(list)
        for i in rows.tolist():
            lines[int(c["at"][i] - c["nth"][i])].append(i)
        matched, equal, fit, n_slots, kept = set(), 0, 0, 0, []
        for line in sorted(lines):
            own, slots = lines[line], {}
            for i in own:
                a, b, kind = (np.frombuffer(v[i], t) for v, t in zip(values, (np.uint64, np.uint64, np.int8), strict=True))
                slots |= {int(c["nth"][i]) + j: (int(a[j]), int(b[j])) for j in np.flatnonzero(kind != WORD).tolist()}
            if which == WHOLE:
                if len({int(c["nth"][i]) for i in own}) == total:
                    return which, 1, 1, 1.0, "copy", len(slots), len(slots), int(c["start"][own].min()), int(c["end"][own].max())
                continue
            ok, same, m = agreement([slots[p] for p in sorted(slots)])
            if m and ok < consistency * m:
                continue
            matched |= {int(c["nth"][i]) for i in own}
            fit, equal, n_slots, kept = fit + ok, equal + same, n_slots + m, kept + own
        if not matched:
            return None
        share, nths = len(matched) / total, np.array(sorted(matched))
        longest = int(np.diff(np.flatnonzero(np.r_[True, np.diff(nths) != 1, True])).max())
        if share < coverage and longest + n - 1 < run_words:
            return None
        return which, total, len(matched), share, "copy" if equal == n_slots else "reparameterised", n_slots, fit, int(c["start"][kept].min()), int(c["end"][kept].max())

    def run(table: pa.Table) -> pa.Table:
        c = {x: table.column(x).to_numpy() for x in ("row", "item", "which", "nth", "at", "n", "n_windows", "start", "end")}
        values = tuple(table.column(x).to_pylist() for x in ("item_values", "doc_values", "item_kinds"))
        order = np.lexsort((c["at"], c["nth"], c["which"], c["item"], c["row"]))
        best: dict[tuple[int, int], tuple] = {}
        new = np.any([np.diff(c[x][order]) != 0 for x in ("row", "item", "which")], axis=0)
        for rows in np.split(order, np.flatnonzero(new) + 1):
            name, got = (int(c["row"][rows[0]]), int(c["item"][rows[0]])), pair(rows, c, values)
            if got and (name not in best or best[name][1][3] < got[3]):  # of both templates the one that covers more
                best[name] = int(rows[0]), got
        first = pa.array([i for i, _ in best.values()], pa.int64())
        told = list(zip(*(got[1:] for _, got in best.values()), strict=True)) or [()] * 8
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        columns = [table.column("row_id").take(first), table.column("item_id").take(first), *(pa.array(list(x), t) for x, t in zip(told, kinds, strict=True))]
        return pa.table(columns, ["row_id", "item_id", "n_windows", "n_matched", "coverage", "kind", "n_slots", "n_slots_fit", "start", "end"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", k: int = 8, coverage: float = 0.4, run_words: int = 20, consistency: float = 0.7, block: int = 100_000, filter_bits: int = 1 << 28, rows_per_salt: int = 1_000_000) -> DataFrame:
    """One row per document and benchmark item that it holds: id, item_id, n_windows (of the item), n_matched, coverage,
    kind (copy or reparameterised), n_slots, n_slots_fit, start and end of the match (code points).

    A document holds an item if it matches ``coverage`` of its windows, or ``run_words`` consecutive template tokens, on
    diagonals where at least ``consistency`` of the slots fit a one-to-one map. Of the template with names and the one
    without, the one that covers more is reported. Items of under ``k`` tokens, or without a
    window of mostly words in either, match where all their words, numbers and units stand in order (one window then).
    ``block``: matched windows that one task settles, about. ``filter_bits``: of the filter, which every worker holds; beyond about
    a tenth as many windows of the benchmark it lets many others through, which the join then drops. ``rows_per_salt``: documents with one
    window or item that one task joins.
    Defined cases: null and empty texts on either side match nothing; null ids and repeated rows are reported like
    others; an empty table on either side gives no rows; other columns of the inputs are not read.
    """
    own = lambda df, col, name: {name: df.schema[col].dataType}
    kinds = lambda ddl, ids: StructType([StructField(f.name, ids.get(f.name, f.dataType)) for f in StructType.fromDDL(ddl.format(id="int", item="int")).fields])
    items = saved(benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(_items(k), kinds(ITEMS, own(benchmark, item_col, "item_id"))), "items")
    sizes = [r[0] for r in items.where(F.col("which") == WHOLE).select("n").distinct().collect()]  # k of them at most
    texts = small_batches(docs).select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    hits = saved(texts.mapInArrow(_hits(k, sizes, bounded_filter(items, "h", 256, filter_bits)), kinds(HITS, own(docs, id_col, "row_id"))), "hits")

    # a pair that holds has ``need`` of the item's windows, so it has one of all but the need - 1 that most items share
    need = F.when(F.col("which") == WHOLE, F.col("n_windows")).otherwise(F.greatest(F.lit(1), F.least(F.ceil(F.col("n_windows") * coverage - 1e-9), F.lit(max(1, run_words - k + 1)))))
    common = items.groupBy("h").agg(F.count("*").alias("held"))
    seen = hits.groupBy("h").agg(F.count("*").alias("seen"))
    rare = Window.partitionBy("item", "which").orderBy(F.coalesce("seen", F.lit(0)) * F.col("held"), "h", "nth")  # by the pairs that a window makes
    keys = items.select("item", "which", "nth", "h", "n_windows").join(common, "h").join(seen, "h", "left").withColumn("place", F.row_number().over(rare)).where(F.col("place") <= F.col("n_windows") - need + 1)
    # a window, or an item, that many documents hold is dealt out by document
    pairs = salted_join(hits.select("row", "h"), keys.select("item", "which", "h"), ["h"], ["row"], rows_per_salt).select("row", "item", "which").distinct()
    wanted = salted_join(saved(pairs, "pairs"), items, ["item", "which"], ["row"], rows_per_salt)
    met = saved(hits.drop("which").join(wanted, ["row", "h"]), "matched-windows")
    tasks = max(1, -(-met.count() // block))
    out = met.withColumn("task", F.pmod(F.xxhash64("row", "item"), F.lit(tasks))).groupBy("task").applyInArrow(_settled(coverage, run_words, consistency), kinds(OUT, own(met, "row_id", "row_id") | own(met, "item_id", "item_id")))
    return out.withColumnsRenamed({"row_id": id_col})
