"""Places, ranks and least rows, without one task that sees all rows or all of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import saved


def same(a: list[Column], b: list[Column]) -> Column:
    """Equal one by one; null equals null."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0, group: list[str] | None = None, size: str | None = None, rows_per_task: int = 1_000_000) -> DataFrame:
    """``name``: each row's place by ``order`` (null first), from ``start``, in its group or in all; ``size``: the rows of its group.

    Rows are dealt into ranges of (group, order) and numbered inside each; the number of a group's rows in the ranges before is
    the offset, a row a group and range. Rows that agree in all of these are dealt on by where they were read, so neither a group nor
    a value is one task's. Null is a group like others; an empty table gives no rows.
    """
    group = group or []
    spark = df.sparkSession
    read = saved(df.withColumn("_tie", F.monotonically_increasing_id()), "unordered")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read.count() // rows_per_task))
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in [*group, *order, "_tie"]]
    ranged = read.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    rows = saved(ranged.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "ordered")
    own = [F.col(f"`{c}`") for c in group]
    held = rows.groupBy("_part", *(c.alias(f"_g{i}") for i, c in enumerate(own))).agg(F.min("_row").alias("_first"), F.count("*").alias("_held"))
    # over the ranges of a group: their number, not that of its rows
    named = [f"_g{i}" for i in range(len(group))]
    every = Window.partitionBy(*(named or [F.lit(0)]))
    before = F.sum("_held").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_held")
    offsets = held.withColumns({"_before": before, "_size": F.sum("_held").over(every)}).withColumnRenamed("_part", "_of")
    out = rows.join(offsets, (F.col("_part") == F.col("_of")) & same(own, [F.col(c) for c in named]))
    out = out.withColumn(name, (F.col("_before") + F.col("_row") - F.col("_first") + start).cast("long"))
    out = out.withColumn(size, F.col("_size")) if size else out
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in (name, size)), name, *([size] if size else []))


# ---------------------------------------------------------------- order statistics


def counted(df: DataFrame, value: str, group: str) -> DataFrame:
    """(grp, v, c): how often each value (as double) stands in each group; null values are left out."""
    x = df.select(F.col(group).alias("grp"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    return saved(x.groupBy("grp", "v").agg(F.count("*").alias("c")), "counted-values")


def at_ranks(values: DataFrame, wanted: DataFrame, buckets: int = 1024) -> DataFrame:
    """(grp, rank, v): the value at each rank (from 1) of ``wanted`` (grp, rank) among ``values`` (grp, v, c).

    A group's values are counted in equal buckets between its least and largest one; the bucket that holds a rank is the next
    round's whole, until it holds one value. A round reads a count a bucket: no group is sorted. Ranks beyond the rows give none.
    """
    ends = values.groupBy("grp").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    spans = wanted.distinct().join(ends, wanted["grp"].eqNullSafe(ends["grp"])).select(wanted["grp"], "rank", "lo", "hi", F.col("rank").alias("left"))
    done = None
    while True:
        spans = saved(spans, "spans")
        found = spans.where("lo = hi").select("grp", "rank", F.col("lo").alias("v"))
        done = found if done is None else done.unionByName(found)
        spans = spans.where("lo < hi")
        if not spans.head(1):
            return done
        open_ = spans.select(F.col("grp").alias("g"), "lo", "hi").distinct()
        inside = values.join(open_, values["grp"].eqNullSafe(open_["g"]) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        place = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)).cast("int")
        held = inside.groupBy("g", "lo", place.alias("bucket")).agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy("g", "lo").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # buckets, not rows
        held = held.withColumn("upto", upto).withColumnRenamed("lo", "from")
        next_ = spans.join(held, F.col("grp").eqNullSafe(F.col("g")) & (F.col("lo") == F.col("from")) & (F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("n")))
        spans = next_.select("grp", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("left") - F.col("upto") + F.col("n")).alias("left"))


# ---------------------------------------------------------------- the first rows of each key


GATHERED = 30_000  # rows that are sorted together with those that a task holds


def _first_rows(columns: list[str], k: int, held_rows: int, keys: int = 1, last: bool = False):
    """Of a task: each key's number of rows and its ``k`` first ones, by the other columns (null first); the key is the first ``keys`` columns.
    ``last``: its last ones instead, the last one first."""
    by = [(c, "descending" if last else "ascending") for c in columns]
    null = "at_end" if last else "at_start"

    def kept(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=by, null_placement=null))
        key = np.array([pc.fill_null(pc.dictionary_encode(table.column(i)).combine_chunks().indices, -1).to_numpy() for i in range(keys)])
        rows = table.num_rows
        new = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]) if rows else np.zeros(0, int)
        size = np.diff(np.r_[new, rows])
        nth = np.arange(rows) - np.repeat(new, size)
        n = np.add.reduceat(table.column("n").to_numpy(), new) if rows else np.zeros(0, np.int64)
        total = np.zeros(rows, np.int64)
        total[new] = n  # a key's first row carries its number of rows
        return table.set_column(table.num_columns - 1, "n", pa.array(total)).filter(pa.array(nth < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]).append_column("n", pa.array(np.ones(batch.num_rows, np.int64))))
            waiting += batch.num_rows
            if waiting >= min(GATHERED, held_rows):
                held, waiting = [kept(pa.concat_tables(held))], 0
                if held[0].num_rows > held_rows:  # many keys: what is held is told, and gathered with the rest
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from kept(pa.concat_tables(held)).to_batches()

    return run


def first_per_key(df: DataFrame, key: str, order: list[str], k: int, held_rows: int = 100_000, parts: int = 256) -> DataFrame:
    """(key, n, firsts): each key's number of rows, and its ``k`` first rows by ``order`` as structs, in order.

    Every task keeps ``k`` rows a key; they are gathered in ``parts`` of a key, ``k`` rows each, and then by key. Null is a key like
    others, and comes first in an order; rows that repeat count one by one.
    """
    told = df.select(F.col(key), *order)
    kinds = ", ".join(f"`{n}` {t}" for n, t in told.dtypes)
    part = told.mapInArrow(_first_rows([key, *order], k, held_rows), f"{kinds}, n long").withColumn("_part", F.spark_partition_id() % parts)

    def least(held: Column) -> Column:
        return F.slice(F.array_sort(held), 1, k)

    some = part.groupBy(key, "_part").agg(F.sum("n").alias("n"), least(F.collect_list(F.struct(*order))).alias("firsts"))
    return some.groupBy(key).agg(F.sum("n").alias("n"), least(F.flatten(F.collect_list("firsts"))).alias("firsts"))


def last_rows(df: DataFrame, key: list[str], order: list[str], k: int, name: str, held_rows: int = 100_000) -> DataFrame:
    """The ``k`` last rows of each key by ``order`` (null before all), with their place in ``name``, 1 for the last one.

    Every task keeps ``k`` rows a key, so no task sorts its rows, however many a key has.
    """
    told = df.select(*key, *order, *[c for c in df.columns if c not in (*key, *order)])
    kinds = ", ".join(f"`{n}` {t}" for n, t in told.dtypes)
    part = told.mapInArrow(_first_rows([*key, *order], k, held_rows, len(key), True), f"{kinds}, n long").drop("n")
    place = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return part.withColumn(name, F.row_number().over(place)).where(F.col(name) <= k)
