"""Exact dedup by skew-safe combining.

Copies are combined in three stages, each of which groups by the full normalised text beside its digest:

1. *local*: the map side of the first aggregation leaves one row per text and task,
2. *salted*: rows of one digest are spread over ``salts`` by a hash of their id, so that a text which holds a third of
   the corpus is merged by many tasks (rows of one text and one id are one row a task by then),
3. *global*: the winners of the salts (at most ``salts`` rows a text) are combined.

Decisions go back to the rows by two digests that have nothing in common, and the length; that these name one text each is checked
where texts still stand beside them, and the query fails otherwise. On the way back a text of many rows is dealt out by the rows
themselves, whatever their ids are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z only. ``lower`` does the same on texts without other letters, and is much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, rows_per_salt: int = 1_000_000) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of equal texts the row with
    the largest id stays. Defined cases: a null id ranks below every other id and stays only if all ids of its text
    are null; rows that repeat the same id and text all count in group_size, and all carry kept = (id is keep_id);
    an empty table gives no rows; other columns of the input are not read. ``salts``: 16, or as many as keep each salt of a
    text that all rows hold within ``rows_per_salt`` rows.
    """
    salts = salts or max(16, -(-docs.count() // rows_per_salt))
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    name = {"d": F.unhex(F.sha2("t", 256)), "e": F.xxhash64("t"), "chars": F.length("t")}
    local = rows.withColumns(name).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).groupBy(*name, "salt", "t").agg(F.max("id").alias("m"), F.count("*").alias("n"))
    merged = local.groupBy(*name, "t").agg(F.max("m").alias("keep_id"), F.sum("n").alias("group_size")).drop("t")
    one = F.when(F.count("*") == 1, F.sum("group_size")).otherwise(F.raise_error(F.lit("two texts have one name")).cast("long"))
    winners = saved(merged.groupBy(*name).agg(F.max("keep_id").alias("keep_id"), one.alias("group_size")), "texts")
    back = F.ceil(F.col("group_size") / rows_per_salt).cast("int")
    # a text of so many rows is dealt out: there are total / rows_per_salt of them at most
    hot = F.broadcast(winners.where(F.col("group_size") > rows_per_salt).select(*name, back.alias("salts")))
    told = rows.select("id", *(c.alias(x) for x, c in name.items())).withColumn("nth", F.monotonically_increasing_id())
    told = told.join(hot, list(name), "left").withColumn("salt", F.coalesce(F.pmod("nth", "salts").cast("int"), F.lit(0)))
    out = told.drop("salts").join(winners.withColumn("salt", F.explode(F.sequence(F.lit(0), back - 1))), [*name, "salt"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("d")).alias("text_sha256"))


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
