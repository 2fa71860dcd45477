"""Tables of a relational store, read in parallel over ranges of a numeric key, and written with bounded connections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def key_bounds(spark: SparkSession, url: str, table: str, key: str, **options: str) -> tuple[int, int]:
    """Smallest and largest key, found by the store itself (its primary key's index)."""
    asked = spark.read.format("jdbc").options(url=url, query=f"SELECT min({key}) AS lo, max({key}) AS hi FROM {table}", **options).load().first()
    return (0, 0) if asked is None or asked[0] is None else (int(asked[0]), int(asked[1]))


def relational(spark: SparkSession, url: str, table: str, key: str | None = None, rows_per_task: int = 1_000_000, most_connections: int = 64, **options: str) -> DataFrame:
    """A table; filters and columns are pushed to the store. With ``key``, ranges of about ``rows_per_task`` keys are read
    at a time by at most ``most_connections`` tasks; rows outside the bounds or without key still belong to the end ranges."""
    read = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if key is not None:
        lo, hi = key_bounds(spark, url, table, key, **options)
        tasks = max(1, min(most_connections, (hi - lo) // rows_per_task + 1))
        read = read.options(partitionColumn=key, lowerBound=str(lo), upperBound=str(hi + 1), numPartitions=str(tasks))
    return read.load()


def write_relational(df: DataFrame, url: str, table: str, mode: str = "append", most_connections: int = 16, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, numPartitions=str(most_connections), batchsize="5000", **options).mode(mode).save()
