"""Tables that cut lineage: written to the folder that driver and executors share, and read again. They survive lost executors,
which ``persist`` does not, and are deleted where a ``temporary`` block ends, or with the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)  # of the innermost block, in this thread


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In one local process, where it is unset, a temporary folder is set once; on a
    cluster that would be another folder on each machine, so there it is an error."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held
    jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jsc.isDefined():
        return jsc.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(where)
    if (held := _written.get()) is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside go at the end; what was computed from them must be written by then."""
    own: list[str] = []
    before = _written.set(own)
    try:
        yield
    finally:
        _written.reset(before)
        for path in own:
            delete(spark, path)
