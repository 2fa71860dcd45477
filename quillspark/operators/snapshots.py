"""Versioned tables: changes are written aside and switched in by one small manifest, or not at all.

A store is a folder with ``data/`` (Parquet folders that are never changed) and ``manifests/`` (one JSON file a version, which names the
folders of every table). A change checks its rows, writes new folders, and creates the next manifest, which exists at once for
every reader or not at all: a writer that fails leaves the old version as it was, and of two writers that began from one version the
second gets ``Conflict``. Rows of a keyed table lie in buckets of their key, so a change rewrites the buckets it touches alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import delete

WIDTH = 12  # digits of a version in the name of its manifest


class Conflict(Exception):
    """Another writer has switched in a version since this change began."""


class Refused(Exception):
    """The rows of a change break a rule."""


@dataclass
class Version:
    """``tables``: name -> folders (path, bucket or null, and notes); ``notes``: what a stream or an index keeps beside them."""

    number: int = 0
    tables: dict[str, list[dict]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ------------------------------------------------ files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:WIDTH]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _read(self, number: int) -> Version | None:
        """A version; null where its writer died before the end of its manifest."""
        stream = self._fs().open(self._path(f"manifests/{number:0{WIDTH}}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            held = json.loads(text)
        except ValueError:
            return None
        return Version(number, held["tables"], held["schemas"], held["notes"])

    def latest(self) -> Version:
        for number in reversed(self._numbers()):
            if (version := self._read(number)) is not None:
                return version
        return Version()

    # ------------------------------------------------ reading

    def read(self, table: str, version: Version | None = None, buckets: list[int] | None = None, where: Callable[[dict], bool] | None = None) -> DataFrame:
        """A table as of a version (the latest). ``buckets``, ``where``: only these buckets, or folders with such notes, are read."""
        version = version or self.latest()
        if table not in version.schemas:
            raise KeyError(f"no table {table}")
        wanted = [x["path"] for x in version.tables[table] if (buckets is None or x["bucket"] in buckets) and (where is None or where(x))]
        schema = version.schemas[table]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in wanted]) if wanted else self.spark.createDataFrame([], schema)

    # ------------------------------------------------ changing

    @contextmanager
    def change(self, base: Version | None = None) -> Iterator[Change]:
        """A change of the latest version, or of ``base``. It is switched in where the block ends; an error in it switches nothing
        in and deletes what was written aside."""
        last = max(self._numbers(), default=0)
        base = base or self.latest()
        change = Change(self, base)
        try:
            yield change
            if change.changed:
                # a version after ``base`` is another writer's
                number = max(base.number, last) + 1
                if any(self._read(n) is not None for n in self._numbers() if n > base.number):
                    raise Conflict(f"version {base.number} is no longer the latest")
                change.new.number = number
                self._switch(change.new)
        except BaseException:
            for path in change.written:
                delete(self.spark, f"{self.path}/{path}")
            raise

    def _switch(self, version: Version) -> None:
        text = json.dumps({"tables": version.tables, "schemas": version.schemas, "notes": version.notes}, ensure_ascii=False)
        where = self._path(f"manifests/{version.number:0{WIDTH}}.json")
        try:
            stream = self._fs().create(where, False)  # fails if it exists
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {version.number} is another writer's") from e
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests before the last ``keep`` versions, and the folders that no kept one names; how many folders went."""
        numbers = [n for n in self._numbers() if self._read(n) is not None]
        kept = [self._read(n) for n in numbers[-keep:]]
        held = {x["path"] for v in kept for folders in v.tables.values() for x in folders}
        gone = {x["path"] for n in numbers[:-keep] for folders in self._read(n).tables.values() for x in folders} - held
        for n in numbers[:-keep]:
            delete(self.spark, f"{self.path}/manifests/{n:0{WIDTH}}.json")
        for path in gone:
            delete(self.spark, f"{self.path}/{path}")
        return len(gone)


class Change:
    """What a block writes aside. ``new`` is the version that it leads to."""

    def __init__(self, store: Store, base: Version):
        self.store, self.base = store, base
        self.new = Version(0, {k: list(v) for k, v in base.tables.items()}, dict(base.schemas), json.loads(json.dumps(base.notes)))
        self.written: list[str] = []
        self.changed = False

    def _write(self, df: DataFrame, table: str, bucketed: bool) -> str:
        path = f"data/{table}-{uuid.uuid4().hex}"
        self.written.append(path)
        writer = df.write.partitionBy("_bucket") if bucketed else df.write
        writer.parquet(f"{self.store.path}/{path}")
        return path

    def _folders(self, path: str) -> list[int]:
        """The buckets of a folder just written: from its names, not its rows."""
        fs, where = self.store._fs(), self.store._path(path)
        return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(where) if x.getPath().getName().startswith("_bucket="))

    def _schema(self, table: str, df: DataFrame) -> None:
        kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        if self.new.schemas.setdefault(table, kinds) != kinds:
            raise Refused(f"{table} holds {self.new.schemas[table]}, not {kinds}")
        self.new.tables.setdefault(table, [])

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.store.buckets)).cast("int")

    def create(self, table: str, df: DataFrame, key: str) -> None:
        """A keyed table's first rows, or all of them anew."""
        self._schema(table, df)
        path = self._write(df.withColumn("_bucket", self.bucket(key)).repartition("_bucket"), table, True)
        self.new.tables[table] = [{"path": f"{path}/_bucket={b}", "bucket": b} for b in self._folders(path)]
        self.changed = True

    def replace(self, table: str, rows: DataFrame, key: str, keys: DataFrame | None = None) -> list[int]:
        """All rows of the keys in ``keys`` (default: those of ``rows``) become ``rows``; the buckets that were rewritten. Rows of other keys in
        them are copied; other buckets are not read."""
        self._schema(table, rows)
        keys = (rows if keys is None else keys).select(key).distinct()
        touched = sorted(r[0] for r in keys.select(self.bucket(key)).distinct().collect())  # buckets: a bounded number
        if not touched:
            return []
        held = self.store.read(table, self.new, touched)
        named = keys.select(F.col(key).alias("_key"))
        after = held.join(named, held[key].eqNullSafe(named["_key"]), "left_anti").unionByName(rows)
        path = self._write(after.withColumn("_bucket", self.bucket(key)).repartition("_bucket"), table, True)
        fresh = [{"path": f"{path}/_bucket={b}", "bucket": b} for b in self._folders(path)]
        self.new.tables[table] = [x for x in self.new.tables[table] if x["bucket"] not in touched] + fresh
        self.changed = True
        return touched

    def merge(self, table: str, rows: DataFrame, key: str, combine: Callable[[DataFrame, list[str]], DataFrame], rows_per_task: int = 500_000) -> list[int]:
        """``combine`` makes new rows of ``rows`` (a saved table: it is read more than once) and of what their buckets hold, and may group them by
        ``key``, others and the columns that it is told; the buckets, which are read and written once. Both are dealt by key into as
        many tasks as they have rows for, so a task's rows are few whatever the size of a bucket."""
        self._schema(table, rows)
        touched = sorted(r[0] for r in rows.select(self.bucket(key)).distinct().collect())  # buckets: a bounded number
        if not touched:
            return []
        if any(x["bucket"] in touched for x in self.new.tables[table]):
            rows = self.store.read(table, self.new, touched).unionByName(rows)
        tasks = -(-rows.count() // rows_per_task)
        parts = -(-8 * tasks // self.store.buckets)  # of a bucket: several a task, so that tasks are alike
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(F.col(key)), F.lit(self.store.buckets * parts)).cast("int")).repartition(tasks, "_part")
        after = combine(dealt, ["_part"])
        path = self._write(after.withColumn("_bucket", F.col("_part") % self.store.buckets).drop("_part"), table, True)
        fresh = [{"path": f"{path}/_bucket={b}", "bucket": b} for b in self._folders(path)]
        self.new.tables[table] = [x for x in self.new.tables[table] if x["bucket"] not in touched] + fresh
        self.changed = True
        return touched

    def append(self, table: str, df: DataFrame, **notes) -> None:
        """Rows of a table without key, as a folder of their own with notes."""
        self._schema(table, df)
        self.new.tables[table].append({"path": self._write(df, table, False), "bucket": None, **notes})
        self.changed = True

    def drop(self, table: str, where: Callable[[dict], bool]) -> int:
        """Folders whose notes fit go."""
        before = self.new.tables.get(table, [])
        self.new.tables[table] = [x for x in before if not where(x)]
        self.changed |= len(before) != len(self.new.tables[table])
        return len(before) - len(self.new.tables[table])

    def compact(self, table: str, **notes) -> None:
        """The folders of a table without key become one."""
        self.new.tables[table] = [{"path": self._write(self.store.read(table, self.new), table, False), "bucket": None, **notes}]
        self.changed = True

    def note(self, name: str, value) -> None:
        self.new.notes[name] = value
        self.changed = True


def replace_chunks(store: Store, new: DataFrame, articles: DataFrame | None = None, base: Version | None = None) -> Version:
    """The chunks of the articles in ``new`` (or in ``articles``, whose chunks may be gone) are replaced as a whole, or not at all.

    Refused: a null or negative index, an index that repeats within an article, a null article, an article that is not named.
    """
    wrong = "article_id IS NULL OR chunk_index IS NULL OR chunk_index < 0"
    if new.where(wrong).head(1):
        raise Refused("a chunk without article, or with a null or negative index")
    if new.groupBy("article_id", "chunk_index").count().where("count > 1").head(1):
        raise Refused("an index repeats within an article")
    if articles is not None and new.join(articles.select("article_id"), "article_id", "left_anti").head(1):
        raise Refused("chunks of an article that is not replaced")
    with store.change(base) as change:
        change.replace("article_chunks", new, "article_id", articles)
    return store.latest()
