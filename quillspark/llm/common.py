"""What the operators of this subpackage share: shared storage, guarded broadcasts, small vectorised text kernels.

Text kernels work on the UTF-8 bytes of Arrow string columns. A *block* is a run of consecutive rows whose
texts hold about ``BLOCK_BYTES``; a longer text is a block of its own, so no text is ever cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.storage import saved, shared_dir, temporary  # noqa: F401  operators take them from here

BLOCK_BYTES = 1_000_000

#: Unit constants of a 64-bit finaliser (public domain "fmix64") and odd multipliers for combining words.
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


# ---------------------------------------------------------------- rows


def small_batches(docs: DataFrame, rows: int = 2_000) -> DataFrame:
    """Whole texts go to Python at most ``rows`` at a time, from here on in this session: Arrow batches are counted in rows, and
    10,000 texts can be more than a worker's memory. A smaller setting is left alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return docs


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], rows_per_salt: int = 1_000_000, most: int = 1_000_000) -> DataFrame:
    """``left`` (a saved table) joined with ``right`` on ``on``; a key that more than ``rows_per_salt`` rows of ``left`` hold is dealt out by ``spread``, and
    its rows of ``right`` are given to each salt. Such keys are ``most`` at most: beyond, ever larger ones count."""
    from_ = max(rows_per_salt, -(-left.count() // most))
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > from_).select(*on, F.ceil(F.col("_n") / from_).cast("int").alias("_salts"))
    hot = F.broadcast(saved(hot, "hot-keys"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), "_salts").cast("int"), F.lit(0))
    dealt = left.join(hot, on, "left").withColumn("_salt", salt).drop("_salts")
    given = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(given, [*on, "_salt"]).drop("_salt")


# ---------------------------------------------------------------- expressions


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def match_spans(text: Column, pattern: str, block: int = 256) -> Column:
    """The matches of a pattern as an array of (s, e, hit), in code points. Regular expressions give texts, not places, so places are
    running sums of lengths; sums run inside blocks and over the blocks, so the work does not grow with the square of the matches."""
    cut = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    wide = lambda x: x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))
    pieces = lambda held: F.transform(F.sequence(F.lit(1), F.size(held), F.lit(block)), lambda i: F.slice(held, i, F.lit(block)))
    width = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + wide(x))
    starts = lambda parts: F.aggregate(F.transform(parts, width), F.array(F.lit(0)), lambda held, n: F.concat(held, F.array(F.element_at(held, -1) + n)))
    span = "array<struct<s:int,e:int,hit:string>>"

    def step(acc: Column, x: Column) -> Column:
        s, e = acc["at"] + x["gap"], acc["at"] + wide(x)
        return F.struct(e.alias("at"), F.concat(acc["spans"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit")))).alias("spans"))

    within = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), F.array().cast(span).alias("spans")), step, lambda acc: acc["spans"])
    every = bound(bound(cut, pieces), lambda parts: F.flatten(F.zip_with(parts, starts(parts), lambda part, at: F.coalesce(within(part, at), F.array().cast(span)))))
    return F.filter(every, lambda x: x["hit"].isNotNull())


# ---------------------------------------------------------------- kernels


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_1
    x ^= x >> np.uint64(33)
    x *= MIX_2
    x ^= x >> np.uint64(33)
    return x


def _byte_values() -> np.ndarray:
    """A 64-bit value per byte, drawn from the mixer; A-Z share the value of a-z."""
    out = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD[0]))
    out[65:91] = out[97:123]
    return out


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
BYTE = _byte_values()
BYTE[WHITE] = 0
_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = max(256, 1 << int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[0] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, ODD[1], np.uint64)])
    return _POWERS[0]


def string_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive blocks; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    held = column.buffers()
    off = np.frombuffer(held[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(held[2], np.uint8) if held[2] is not None and held[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def tokens(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run where ``gap`` is false, and the number of runs of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    starts = ~gap
    starts[1:] &= gap[:-1] | first[1:n]
    ends = ~gap
    ends[:-1] &= gap[1:] | first[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.diff(np.searchsorted(s, off))


def spread(starts: np.ndarray, n: int) -> np.ndarray:
    """For each byte from the first start on: how far it is from the last start at or before it."""
    return np.arange(starts[0], n, dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.r_[starts, n]))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray | None = None, values: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each run of bytes. Bytes between runs must have the value 0, or be true in ``gap``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    with np.errstate(over="ignore"):
        v = values[data[starts[0] :]]
        if gap is not None:
            v[gap[starts[0] :]] = 0
        pos = spread(starts, len(data))
        np.minimum(pos, int(length.max()) - 1, out=pos)
        v *= powers(int(length.max()))[pos]
        h = np.add.reduceat(v, starts - starts[0])
        return mix(h + length.astype(np.uint64) * np.uint64(ODD[2]))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z as a-z) of a block, and the number of words of each row."""
    s, e, counts = tokens(data, off, WHITE[data])
    return run_hashes(data, s, e), counts


def shingle_sets(words: np.ndarray, counts: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's ``k``-word shingles; fewer words: the whole sequence as one; none: empty."""
    empty, out = np.zeros(0, np.uint64), []
    with np.errstate(over="ignore"):
        n = len(words)
        rolled = np.zeros(n, np.uint64)
        if n >= k:
            for i in range(k):
                rolled[: n - k + 1] += words[i : n - k + 1 + i] * np.uint64(ODD[i % 5])
            rolled = mix(rolled)
        ends = np.cumsum(counts)
        for to, c in zip(ends.tolist(), counts.tolist(), strict=True):
            at = to - c
            if c >= k:
                out.append(np.unique(rolled[at : to - k + 1]))
            elif c:
                short = np.uint64(c)
                for i in range(c):
                    short = short * np.uint64(ODD[3]) + words[at + i] * np.uint64(ODD[i % 5])
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(empty)
    return out


# ---------------------------------------------------------------- filters


PIECE = 1 << 16


@dataclass
class Filter:
    """Lets through all the 64-bit values it was made of and, as long as its bits suffice, few others."""

    marks: np.ndarray
    bits: int

    def passes(self, values: np.ndarray) -> np.ndarray:
        return np.logical_and(*((self.marks[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 for p in _places(values, self.bits)))


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = values.view(np.uint64)
    return (x & np.uint64(bits - 1)).astype(np.int64), (mix(x) & np.uint64(bits - 1)).astype(np.int64)


def _marks(bits: int):
    """A task's part of a filter, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy(), bits):
                seen[place] = True
        pieces = [(i, x) for i, x in enumerate(np.packbits(seen).reshape(-1, min(PIECE, bits // 8))) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int32()), pa.array([x.tobytes() for _, x in pieces], pa.binary())], ["piece", "marks"])

    return run


def _either(table: pa.Table) -> pa.Table:
    out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("marks").to_pylist()])
    return pa.table({"piece": table.column("piece")[:1], "marks": pa.array([out.tobytes()], pa.binary())})


def bounded_filter(df: DataFrame, column: str, per_value: int = 16, most: int = 1 << 28) -> Filter:
    """Of a column of longs without nulls: ``per_value`` bits each, ``most`` (32 MB) at most whatever the number of values."""
    bits = min(most, max(1 << 10, 1 << (per_value * df.count() - 1).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    for r in df.select(column).mapInArrow(_marks(bits), "piece int, marks binary").groupBy("piece").applyInArrow(_either, "piece int, marks binary").toLocalIterator():
        out[r["piece"] * len(r["marks"]) : (r["piece"] + 1) * len(r["marks"])] = np.frombuffer(r["marks"], np.uint8)
    return Filter(out, bits)
