"""SimHash near-duplicates by ball hashing that meets in the middle.

Fingerprints that differ in three bits or fewer have a common *variant* between them: one at most one bit from the one and two
from the other. Of all variants those with an even number of ones suffice: a fingerprint with an even number emits itself and
all variants two bits away, one with an odd number all variants one bit away, and any two linked ones still meet. Those that
meet at a variant, one of them at most a bit away, are all linked with that one: a star of links tells a variant's class, and
no variant's fingerprints are paired with each other. A variant that all meet at from two bits away tells nothing new.

Variants are shuffled by their first bits: a fingerprint goes to every cell that a variant of it falls in, and the rest of the
variants is emitted in the cell, so a variant costs no row. A cell that would hold too many is cut by further bits, down to all
64, where a cell is one variant, which at most 2,081 different fingerprints can reach. Copies of a fingerprint are one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ODD, WHITE, saved, small_batches, string_blocks, tokens
from .jaccard_join import _united, classes

SEED, BITS, RADIUS = 42, 64, 3
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def shingle_spans(data: np.ndarray, off: np.ndarray, k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, lower-cased and parted by one space; start and end of each row's ``k``-word shingles, repeats included
    (fewer words: the whole sequence), and the number of shingles of each row."""
    gap = WHITE[data]
    s, e, counts = tokens(data, off, gap)
    size = e - s
    begin = np.cumsum(size + 1) - (size + 1)
    text = np.full(int(size.sum()) + len(s), 32, np.uint8)
    text[np.arange(int(size.sum())) + np.repeat(np.arange(len(s)), size)] = FOLD[data[~gap]]
    shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
    last = first + np.repeat(np.minimum(counts, k), shingles) - 1
    return text.tobytes(), begin[first], begin[last] + size[last], shingles


def fingerprints(data: np.ndarray, off: np.ndarray, k: int = 3, at_once: int = 200_000) -> np.ndarray:
    """Of each row, the bits that are set in over half of its shingles' hashes; 0 without words."""
    text, start, end, shingles = shingle_spans(data, off, k)
    ones = np.zeros((len(shingles), BITS), np.int64)
    row = np.repeat(np.arange(len(shingles)), shingles)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), at_once):
        h = np.array([digest(text[a:b], SEED) for a, b in zip(start[at : at + at_once].tolist(), end[at : at + at_once].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = row[at : at + at_once]
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        ones[of[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _named(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.int64(TaskContext.get().partitionId() << 40)
        for batch in batches:
            fp = np.zeros(batch.num_rows, np.uint64)
            for at, to, data, off in string_blocks(batch.column(1)):
                fp[at:to] = fingerprints(data, off, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), pa.array(seen + np.arange(batch.num_rows))], ["id", "fp", "row"])
            seen += batch.num_rows

    return run


def flips(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, ones) of every choice of at most ``most`` of ``bits`` bits."""
    return [(sum(1 << i for i in some), n) for n in range(min(most, bits) + 1) for some in combinations(range(bits), n)]


def spread(entries: DataFrame, at: int, step: int) -> DataFrame:
    """Entries (fp, cell, left) over the first ``at`` bits, spread over ``step`` further ones: ``left`` bits may yet differ."""
    own = F.shiftrightunsigned("fp", BITS - at - step).bitwiseAND((1 << step) - 1)
    masks = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("ones")) for m, n in flips(step, 2)))
    out = entries.withColumn("own", own).withColumn("x", F.explode(F.filter(masks, lambda x: x["ones"] <= F.col("left"))))
    cell = F.shiftleft("cell", step).bitwiseOR(F.col("own").bitwiseXOR(F.col("x.mask")))
    return out.select("fp", cell.alias("cell"), (F.col("left") - F.col("x.ones")).cast("int").alias("left"))


def variants(left: Column, free: int) -> Column:
    """How many variants an entry has in its cell, with ``free`` bits open."""
    return F.when(left == 2, 1 + comb(free, 2)).when(left == 1, max(1, free)).otherwise(1)


def met(fp: np.ndarray, left: np.ndarray, cell: int, free: int, at_once: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs that connect all that meet at the variants of one cell: (a fingerprint at most a bit away, another)."""
    odd = (np.bitwise_count(fp) & 1).astype(bool)
    low = np.uint64((1 << free) - 1)
    here = np.uint64((cell << free) & ((1 << BITS) - 1)) | (fp & low)
    one = np.array([m for m, n in flips(free, 1) if n], np.uint64)
    two = np.array([m for m, n in flips(free, 2) if n == 2], np.uint64)
    turn = lambda who, masks: ((here[who][:, None] ^ masks).ravel(), np.repeat(who, len(masks)))
    self_, odd_one, odd_none = (np.flatnonzero(x) for x in (~odd & (left == 2), odd & (left == 1), odd & (left == 0)))
    # near: at most a bit away; the fingerprint itself comes first, then the smallest
    z, who = (np.concatenate(x) for x in zip((here[self_], self_), turn(odd_one, one), (here[odd_none], odd_none), strict=True))
    if not len(z):
        return z, z
    order = np.lexsort((fp[who], odd[who], z))
    z, who = z[order], who[order]
    first = np.r_[True, z[1:] != z[:-1]]
    spot, centre = z[first], who[first]
    left_out, right_out = [centre[np.cumsum(first) - 1][~first]], [who[~first]]
    # far: two bits away; few of these variants are those of a near one
    size = max(10, int(16 * len(spot)).bit_length())
    slot = lambda x: ((x * np.uint64(ODD[0])) >> np.uint64(BITS - size)).astype(np.int64)
    taken = np.zeros(1 << size, bool)
    with np.errstate(over="ignore"):
        taken[slot(spot)] = True
        for some, masks in ((self_, two), (np.flatnonzero(~odd & (left == 1)), one), (np.flatnonzero(~odd & (left == 0)), np.zeros(1, np.uint64))):
            rows = max(1, at_once // max(1, len(masks)))
            for at in range(0, len(some) if len(masks) else 0, rows):
                z, who = turn(some[at : at + rows], masks)
                ok = taken[slot(z)]
                z, who = z[ok], who[ok]
                place = np.minimum(np.searchsorted(spot, z), len(spot) - 1)
                ok = spot[place] == z
                left_out.append(centre[place[ok]])
                right_out.append(who[ok])
    a, b = np.concatenate(left_out), np.concatenate(right_out)
    linked = (np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS) & (a != b)
    return a[linked], b[linked]


def _stars(free: int):
    """(a, b): of one cell, each fingerprint with links and the smallest one that they connect it with."""

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        names, first = np.unique(fp, return_index=True)
        a, b = met(names.view(np.uint64), table.column("left").to_numpy()[first], int(table.column("cell")[0].as_py()), free)
        top = names[_united(len(names), a, b)]  # the smallest place is the smallest name
        moved = top != names
        return pa.table({"a": pa.array(names[moved]), "b": pa.array(top[moved])})

    return run


def links(prints: DataFrame, distinct: int, per_cell: int = 1000, most: int = 20_000_000, step: int = 12) -> DataFrame:
    """(a, b): links that connect exactly the classes of ``prints`` (fp, all different). Cells hold about ``per_cell`` fingerprints;
    those whose entries would emit over ``most`` variants are cut by ``step`` further bits."""
    at = min(40, max(1, (distinct // per_cell).bit_length()))
    start = prints.select("fp", F.lit(0).cast("long").alias("cell"), F.when(F.bit_count("fp") % 2 == 0, 2).otherwise(1).alias("left"))
    entries, out = spread(start, 0, at), None
    while True:
        free = BITS - at
        hot = None
        if free:
            hot = saved(entries.groupBy("cell").agg(F.sum(variants(F.col("left"), free)).alias("cost")).where(F.col("cost") > most).select("cell"), "hot-cells")
            hot = hot if hot.head(1) else None
        cool = entries if hot is None else entries.join(hot, "cell", "left_anti")
        found = cool.groupBy("cell").applyInArrow(_stars(free), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if hot is None:
            return out
        more = min(step, free)
        entries, at = spread(entries.join(hot, "cell", "left_semi"), at, more), at + more


def components(rows: DataFrame, rows_per_salt: int = 1_000_000, **how: int) -> DataFrame:
    """(id, fp, component_id) of rows (id, fp, row): the smallest id that links of at most ``RADIUS`` bits reach."""
    prints = saved(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("held")), "fingerprints")
    distinct, total = prints.agg(F.count("*"), F.coalesce(F.sum("held"), F.lit(0))).first()
    label = classes(links(prints, distinct, **how).distinct())
    root = F.col("fp") if label is None else F.coalesce("root", "fp")
    tied = prints if label is None else prints.join(label.withColumnRenamed("node", "fp"), "fp", "left")
    tied = tied.withColumn("root", root)
    named = tied.join(tied.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    hot_from = max(rows_per_salt, -(-total // rows_per_salt))
    salts = F.ceil(F.col("held") / hot_from).cast("int")
    named = named.select("fp", "component_id", salts.alias("salts")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # a fingerprint of more than hot_from rows is salted: there are total / hot_from of them at most
    hot = F.broadcast(prints.where(F.col("held") > hot_from).select("fp", salts.alias("salts")))
    salted = rows.join(hot, "fp", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), "salts").cast("int"), F.lit(0))).drop("salts")
    return salted.join(named.drop("salts"), ["fp", "salt"]).select("id", "fp", "component_id")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, **how: int) -> DataFrame:
    """One row per input row: id, fingerprint (16 hexadecimal digits), component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z; a fingerprint bit is set if it is set in over half of the XXH64 hashes (seed 42)
    of the ``k``-word shingles, repeats included; fewer words are one shingle. Fingerprints link at 3 or fewer differing bits.
    Defined cases: null, empty and blank texts have the fingerprint 0, which links like any other; null ids name a class only if it
    has no other; repeated rows have one fingerprint and one class; an empty table gives no rows; other columns are not read.
    """
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = saved(texts.mapInArrow(_named(k), f"id {docs.schema[id_col].dataType.simpleString()}, fp long, row long"), "rows")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return components(rows, **how).select(F.col("id").alias(id_col), shown, "component_id")
