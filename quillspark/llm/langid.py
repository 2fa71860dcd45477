"""Language identification: script ranges, per-word scores, Viterbi over words.

The model is learned from labelled texts only: per language, counts of hashed byte trigrams of words, and which scripts
the language's words use. For a text, each word's script leaves the languages that use it; the trigrams score those; the
best path through the words, with a price for each switch of language, labels spans. The language of most words on the
path is the text's; ``score`` is the share of words on it.

A path with no switch is optimal if no run of words would gain more than the price by leaving it; this is tested for all
texts of a block at once, and only texts that fail it go through the full dynamic programme, together, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import small_batches, string_blocks, tokens

UNKNOWN = "und"

#: First and last code point of the ranges of each script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x9FFF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
NAMES = [*SCRIPTS, "other"]


def _script_table() -> np.ndarray:
    """Script of a character by its first two bytes (of UTF-8); by the first alone for ASCII."""
    out = np.full(1 << 16, len(SCRIPTS), np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for lo, hi in ranges:
            for cp in range(lo, hi + 1, 1 if lo < 0x800 else 64):
                b = chr(cp).encode()
                out[np.arange(256) | b[0] << 8 if len(b) == 1 else b[0] << 8 | b[1]] = i
    return out


SCRIPT = _script_table()
#: Letters for the kernel: a-z in either case, and all bytes of other characters.
GAP = np.ones(256, bool)
GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (buckets, languages) log probabilities
    scripts: np.ndarray  # (scripts, languages) whether the language uses the script
    price: float = 8.0
    floor: float = -4.0


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter byte (word ends count as 0), and the first of each word."""
    b = FOLD[data]
    b[gap] = 0
    first = np.zeros(len(data), bool)
    first[starts] = True
    last = np.zeros(len(data), bool)
    last[ends - 1] = True
    before, after = np.r_[np.uint32(0), b[:-1]], np.r_[b[1:], np.uint32(0)]
    before[first] = 0
    after[last] = 0
    with np.errstate(over="ignore"):
        h = (before * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return ((h >> np.uint32(12)) % np.uint32(buckets))[~gap], np.cumsum(ends - starts) - (ends - starts)


def _words(data: np.ndarray, off: np.ndarray):
    gap = GAP[data]
    s, e, n = tokens(data, off, gap)
    script = SCRIPT[data[s].astype(np.int32) << 8 | np.where(data[s] < 128, 0, data[np.minimum(s + 1, len(data) - 1)])] if len(s) else np.zeros(0, np.uint8)
    return gap, s, e, n, script


def _counts(langs: list[str], buckets: int):
    """(bucket, language, n) of one task's texts; buckets from ``buckets`` on are scripts."""
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((buckets + len(NAMES), len(langs)), np.int64)
        for batch in batches:
            lang = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()])
            for at, to, data, off in string_blocks(batch.column(0)):
                gap, s, e, n, script = _words(data, off)
                if not len(s):
                    continue
                g, _ = _grams(data, s, e, gap, buckets)
                of_word = np.repeat(lang[at:to], n)
                of_gram = np.repeat(of_word, e - s)
                for j in range(len(langs)):
                    total[:buckets, j] += np.bincount(g[of_gram == j], minlength=buckets)
                    total[buckets:, j] += np.bincount(script[of_word == j], minlength=len(NAMES))
        b, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[b, j])], ["bucket", "lang", "n"])

    return run


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 20_000, buckets: int = 1 << 15, price: float = 8.0, least: int = 1_000) -> Model:
    """Learn from about ``max_rows`` labelled rows, chosen by a hash of their ids (all, if there are fewer), but of each
    language from about ``least`` rows or more (all, if it has fewer).

    Rows without id, text or language are not learned from. Counts of trigrams and scripts are summed on the executors;
    the driver gets at most (buckets + scripts) x languages numbers.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    labels = known.groupBy(lang_col).count().collect()
    langs = sorted(r[0] for r in labels)
    n = sum(r["count"] for r in labels)
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros((len(NAMES), 0), bool), price)
    share = {r[0]: min(1.0, max(max_rows / n, least / r["count"])) for r in labels}
    below = F.create_map(*(F.lit(x) for lang in langs for x in (lang, int(np.ceil(share[lang] * (1 << 20))))))
    picked = known.where(F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 20)) < F.element_at(below, F.col(lang_col)))
    counts = picked.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).mapInArrow(_counts(langs, buckets), "bucket int, lang int, n long")
    table = counts.groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((buckets + len(NAMES), len(langs)))
    total[table["bucket"], table["lang"]] = table["n"]
    grams, scripts = total[:buckets], total[buckets:]
    scores = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * buckets))
    return Model(langs, scores.astype(np.float32), scripts > 0.001 * np.maximum(scripts.sum(0), 1), price)


def word_scores(data: np.ndarray, off: np.ndarray, m: Model):
    """Log probability of each language for each word that some language's scripts allow; their starts, ends, rows; of each
    row, how many words are of other scripts and, for rows of such words only, the language whose trigrams fit best."""
    rows = len(off) - 1
    gap, s, e, n, script = _words(data, off)
    row = np.repeat(np.arange(rows), n)
    fits = m.scripts[script]
    some = fits.any(1)
    if not len(s):
        return np.zeros((0, len(m.langs)), np.float32), s, e, row, np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    g, first = _grams(data, s, e, gap, len(m.scores))
    x = np.empty((len(s), len(m.langs)), np.float32)
    for j in range(len(m.langs)):
        x[:, j] = np.add.reduceat(m.scores[:, j].copy()[g], first)
    strange = np.flatnonzero(~some)
    nearest = np.zeros((rows, len(m.langs)))
    np.add.at(nearest, row[strange], x[strange])
    x[~fits] = -np.inf
    if len(strange):  # symbols are no words of another script
        lettered: dict[bytes, bool] = {}
        of = [bytes(data[a:b]) for a, b in zip(s[strange].tolist(), e[strange].tolist(), strict=True)]
        for w in set(of):
            lettered[w] = bool(LETTER.search(w.decode("utf-8", "replace")))
        strange = strange[[lettered[w] for w in of]]
    x, alien = x[some], np.bincount(row[strange], minlength=rows)
    if len(x):
        x -= x.max(1, keepdims=True)
        x -= np.log(np.exp(x).sum(1, keepdims=True))
        np.maximum(x, m.floor, out=x)
    return x, s[some], e[some], row[some], alien, nearest.argmax(1)


def viterbi(x: np.ndarray, counts: np.ndarray, price: float) -> np.ndarray:
    """Best language of each word: rows of ``x`` are words, texts follow each other with ``counts`` words."""
    ends = np.cumsum(counts)
    starts = ends - counts
    full = np.flatnonzero(counts)
    best = np.zeros(len(x), np.int16)
    if not len(x):
        return best
    home = np.add.reduceat(x, starts[full], axis=0).argmax(1)
    best[:] = np.repeat(home, counts[full])
    gain = np.r_[0, np.cumsum(x.max(1).astype(np.float64) - x[np.arange(len(x)), best])]
    # all gains are at least 0, so the best run to leave for is a whole text: refine by runs that the home language does not lose
    lose = np.diff(gain)
    hold = np.where(lose > 0, lose, -(x[np.arange(len(x)), best] - np.sort(x, 1)[:, -2] if x.shape[1] > 1 else np.ones(len(x))))
    total = np.r_[0, np.cumsum(hold)]
    text = np.repeat(np.arange(len(full)), counts[full])
    lift = (total.max() - total.min() + 1.0) * text
    low = np.minimum.accumulate((total[:-1] - lift)) + lift
    worst = np.maximum.reduceat(total[1:] - low, starts[full])
    mixed = full[worst > price]
    if not len(mixed):
        return best
    mixed = mixed[np.argsort(-counts[mixed], kind="stable")]
    size, at = counts[mixed], starts[mixed]
    steps, k = int(size[0]), x.shape[1]
    width = np.searchsorted(-size, -np.arange(steps), "left")  # texts that still have a word at each step
    score = x[at].copy()
    back = [None]
    for t in range(1, steps):
        w = width[t]
        now = score[:w]
        top = now.argmax(1)
        jump = now[np.arange(w), top] - price
        stay = now >= jump[:, None]
        back.append(np.where(stay, np.arange(k, dtype=np.int16), top[:, None].astype(np.int16)))
        score[:w] = np.where(stay, now, jump[:, None]) + x[at[:w] + t]
    cur = score.argmax(1)
    for t in range(steps - 1, -1, -1):
        w = width[t]
        best[at[:w] + t] = cur[:w]
        if t:
            cur[:w] = back[t][np.arange(w), cur[:w]]
    return best


def _label(m: Model, spans: bool, kept: int, text: int):
    names = np.array([*m.langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            pred, score, found = np.full(rows, len(m.langs)), np.zeros(rows), [[] for _ in range(rows)]
            for at, to, data, off in string_blocks(batch.column(text)):
                if not m.langs:
                    continue
                x, s, e, row, alien, nearest = word_scores(data, off, m)
                n = np.bincount(row, minlength=to - at)
                path = viterbi(x, n, m.price)
                votes = np.zeros((to - at, len(m.langs)))
                np.add.at(votes, (row, path), 1)
                top, total = np.where(n > 0, votes.argmax(1), nearest), n + alien
                known = total > 0
                ascii_letters = np.r_[0, np.cumsum(~GAP[data] & (data < 128))]
                odd = np.flatnonzero(known & (np.diff(ascii_letters[off]) == 0))
                for i in odd:  # no ASCII letter: only then is it asked whether other characters are letters
                    known[i] = bool(LETTER.search(bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace")))
                pred[at:to] = np.where(known, top, len(m.langs))
                score[at:to] = np.where(known, votes[np.arange(to - at), top] / np.maximum(total, 1), 0.0)
                if spans and len(s):
                    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                    new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(path) != 0)])
                    for a, b in zip(new, np.r_[new[1:], len(row)] - 1, strict=True):
                        found[at + row[a]].append({"start": int(point[s[a]] - point[off[row[a]]]), "end": int(point[e[b]] - point[off[row[a]]]), "lang": names[path[a]]})
            out = [*(batch.column(i) for i in range(kept)), pa.array(names[pred].tolist(), pa.string()), pa.array(score)]
            if spans:
                out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, [*(f"c{i}" for i in range(kept)), "lang_pred", "score", *["spans"] * spans])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", spans: bool = False) -> DataFrame:
    """The ``keep`` columns, lang_pred, score and, if asked, spans (start, end in code points; lang).

    Defined cases: a null or empty text, and one without letters, is ``und`` with score 0 and no spans; a text with letters,
    but no word in a script that a learned language uses, gets the language whose trigrams fit best, with score 0 and no
    spans; an empty table gives no rows; with nothing to learn from all texts are ``und``; repeated rows are labelled one by
    one; columns not in ``keep`` are not read, and ``keep`` names neither lang_pred, score nor spans.
    """
    schema = StructType([StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]).add("lang_pred", "string").add("score", "double")
    if spans:
        schema = schema.add("spans", ArrayType(StructType().add("start", "integer").add("end", "integer").add("lang", "string")))
    text = keep.index(text_col) if text_col in keep else len(keep)  # a text that is kept travels once
    sent = [F.col(c).alias(f"c{i}") for i, c in enumerate([*keep, *[text_col] * (text == len(keep))])]
    out = small_batches(docs).select(*sent).mapInArrow(_label(model, spans, len(keep), text), schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})
