"""Sharding by sampled splitters, with DataFrame functions only.

1. a size-weighted sample of keys (each row with probability ``sample * size / total``) is drawn by a hash, so reruns agree;
2. its quantiles are the splitters of ``shards * ranges_per_shard`` key ranges, 32 a shard whatever the number of rows; the bytes and rows of every range are
   counted exactly, and a range that came out over ``overfull`` times its share, or over ``rows_per_range`` rows, is subdivided by a hash
   of its keys;
3. running sums inside each range, on top of the exact offsets of the ranges, place every row on one line of bytes, and
   the line is cut into equal shards.

Law ``bytes``: a shard's bytes differ from the others' by at most about the largest row. The key is (digest of the text,
digest of the id): equal texts are neighbours, and a text that fills more than a shard is still cut by its ids.
Parts of ranges hold about ``rows_per_range`` rows at most; where
more rows than that have one id and text, they are dealt out over pieces. To the driver go the sample, of about ``sample`` keys, a row a
range, and a row a part: one for a million rows.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

#: Keys shorter than any other sort before it; levels of the two-step search.
LEVEL = 32


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.concat(F.left(F.md5(text.cast("binary")), F.lit(16)), F.left(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(16))).alias("key"),
    )


def _range_of(key, splitters: list[str]):
    """How many splitters are at or below the key: a search in two steps, each of about the root of their number (LEVEL at least)."""
    if not splitters:
        return F.lit(0)
    step = max(LEVEL, math.isqrt(len(splitters)) + 1)
    fine = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    below = lambda held: F.size(F.filter(held, lambda b: b <= key))
    coarse = below(F.lit([x[0] for x in fine]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(F.element_at(F.array(*[F.lit(x) for x in fine]), coarse)))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 32, sample: int = 8192, overfull: float = 2.0, rows_per_range: int = 1_000_000) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, text_group.

    size is the UTF-8 bytes of the text (null: 0) plus 8. slot numbers a shard's rows from 0 without gaps.
    Defined cases: null texts count as empty, null ids as an id of their own; repeated rows are placed one by one, next
    to each other; with fewer rows than shards some shards stay empty; an empty table gives no rows; other columns of
    the input are not read.
    """
    rows = saved(_sized(docs, id_col, text_col).withColumn("nth_read", F.monotonically_increasing_id()), "shard-keys")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sample = max(sample, 10 * shards * ranges_per_shard)
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    drawn = sorted(r[0] for r in rows.where(unit < F.lit(float(sample)) * F.col("size") / F.lit(float(max(total, 1)))).select("key").distinct().collect())
    wanted = shards * ranges_per_shard
    splitters = sorted({drawn[i * len(drawn) // wanted] for i in range(1, wanted)}) if drawn else []

    placed = rows.withColumn("range", _range_of(F.col("key"), splitters))
    share = total / max(1, len(splitters) + 1)
    counted = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    cuts = {r["range"]: max(min(r["n"], -(-int(r["b"]) // max(1, int(share)))) if r["b"] > overfull * share else 1, -(-r["n"] // rows_per_range)) for r in counted if r["n"] > 1}
    cuts = {k: v for k, v in cuts.items() if v > 1}
    if cuts:
        pieces = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]), F.col("range")), F.lit(1))
        placed = placed.withColumn("sub", F.pmod(F.xxhash64("key", F.lit(1)), pieces).cast("int"))
    else:
        placed = placed.withColumn("sub", F.lit(0))
    # rows that agree in all that the key is made of are alike, so it does not matter which of them stands where
    crowded = [r["range"] for r in counted if r["n"] > 2 * rows_per_range]
    hot = placed.where(F.col("range").isin(crowded)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_range).collect() if crowded else []
    if hot:
        split = F.create_map(*[F.lit(x) for r in hot for x in (r["key"], -(-r["n"] // rows_per_range))])[F.col("key")]
        placed = placed.withColumn("piece", F.coalesce(1 + F.pmod(F.xxhash64("nth_read"), split), F.lit(0)).cast("int"))
    else:
        placed = placed.withColumn("piece", F.lit(0))
    parts = sorted((r["range"], r["sub"], r["piece"], r["b"], r["n"]) for r in placed.groupBy("range", "sub", "piece").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
    before = list(zip(accumulate((p[3] for p in parts), initial=0), accumulate((p[4] for p in parts), initial=0), strict=True))
    offsets = docs.sparkSession.createDataFrame([(*p[:3], *o) for p, o in zip(parts, before, strict=False)], "range int, sub int, piece int, bytes_before long, rows_before long")

    inside = Window.partitionBy("range", "sub", "piece").orderBy("key", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.withColumns({"upto": F.sum("size").over(inside), "nth": F.count("*").over(inside)}).join(F.broadcast(offsets), ["range", "sub", "piece"])
    lined = lined.select("id", "size", "crc", F.left("key", F.lit(16)).alias("text_group"), (F.col("rows_before") + F.col("nth") - 1).alias("row"), ((F.col("bytes_before") + F.col("upto") - F.col("size")) * shards / F.lit(max(total, 1))).cast("int").alias("shard"))
    lined = saved(lined, "shard-rows")
    firsts = {r["shard"]: r["f"] for r in lined.groupBy("shard").agg(F.min("row").alias("f")).collect()}
    first = F.element_at(F.lit([firsts.get(s, 0) for s in range(shards)]), F.col("shard") + 1)
    return lined.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("row") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "text_group")
