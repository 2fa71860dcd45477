"""Uploads as a stream: every batch is applied once and as a whole, whatever is replayed, and every row has a fate.

A batch goes into a ``snapshots.Store`` in one change: new articles, the hashes seen, late uploads, the mark up to which uploads were seen and
the number of the batch switch in together. A replayed batch finds its number in the store and changes nothing.

Fates: ``late`` - uploaded more than ``late`` before the mark of the batches before: kept apart, not stored; ``repeat`` - its
organisation holds the content already, from an earlier batch or earlier in this one; ``new`` - stored as an article.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quillspark.functions.text import content_hash
from quillspark.operators.snapshots import Change, Store
from quillspark.operators.storage import saved, temporary

UPLOADS = "organization_id long, title string, body string, uploaded_at timestamp, upload_id long"
KEY = ["organization_id", "content_hash"]
STAMP = "%Y-%m-%d %H:%M:%S.%f"


def judged(batch: DataFrame, seen: DataFrame, mark: datetime | None, late: timedelta) -> DataFrame:
    """The batch with content_hash and fate; ``seen``: the (organization_id, content_hash) that are held. Uploads without body, time or
    organisation are ``invalid``; of equal ones in a batch the first by time and number is the new one."""
    rows = batch.withColumn("content_hash", content_hash(F.col("body")))
    valid = F.col("body").isNotNull() & (F.trim("body") != "") & F.col("organization_id").isNotNull() & F.col("uploaded_at").isNotNull()
    too_late = F.col("uploaded_at") < F.lit(mark - late) if mark else F.lit(False)
    fate = F.when(~valid, "invalid").when(too_late, "late")
    rows = rows.withColumn("fate", fate)
    nth = F.row_number().over(Window.partitionBy("fate", *KEY).orderBy("uploaded_at", "upload_id"))
    held = seen.select(*KEY, F.lit(True).alias("held")).distinct()
    rows = rows.where("fate IS NULL").withColumn("nth", nth).join(held, KEY, "left").withColumn("fate", F.when(F.col("held") | (F.col("nth") > 1), "repeat").otherwise("new")).drop("nth", "held").unionByName(rows.where("fate IS NOT NULL"))
    return rows.select(*batch.columns, "content_hash", "fate")


def apply_batch(store: Store, batch: DataFrame, number: int, stream: str = "uploads", late: timedelta = timedelta(hours=1), remember: timedelta = timedelta(days=7)) -> bool:
    """Apply batch ``number`` of ``stream`` once; whether it changed anything.

    ``remember``: hashes whose uploads lie so long before the mark leave the quick state - whole folders by their newest upload - and
    are found among the articles instead, so a repeat is a repeat however old; only the state that every batch reads stays small.
    """
    spark = batch.sparkSession
    base = store.latest()
    if base.notes.get(stream, {}).get("batch", -1) >= number:
        return False
    mark = base.notes.get(stream, {}).get("mark")
    mark = datetime.strptime(mark, STAMP) if mark else None
    with temporary(spark), store.change(base) as change:
        batch = saved(batch, "batch")
        if "articles" in base.schemas:
            fresh = batch.select("organization_id", content_hash(F.col("body")).alias("content_hash")).distinct()
            forgotten = base.notes[stream].get("forgotten", False)
            seen = store.read("seen", base)
            # what the quick state forgot is looked for in the buckets of the batch's own hashes
            old = _older(store, change, fresh) if forgotten else None
            seen = seen.select(*KEY) if old is None else seen.select(*KEY).unionByName(old)
            seen = seen.join(fresh, KEY, "left_semi")
        else:
            seen = spark.createDataFrame([], "organization_id long, content_hash string")
        rows = saved(judged(batch, seen, mark, late), "judged")
        new = rows.where("fate = 'new'").drop("fate")
        newest = rows.where("fate IN ('new', 'repeat')").agg(F.date_format(F.max("uploaded_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        held = max((x for x in (newest, base.notes.get(stream, {}).get("mark")) if x), default=None)
        articles = new.withColumn("hash_key", F.col("content_hash"))
        if "articles" in base.schemas:
            # keyed by hash: appended to its bucket's folders, no bucket is rewritten
            _appended(change, "articles", articles)
        else:
            change.create("articles", articles, "hash_key")
        change.append("seen", new.select(*KEY, "uploaded_at"), newest=newest)
        change.append("late", rows.where("fate IN ('late', 'invalid')"), batch=number)
        limit = (datetime.strptime(held, STAMP) - remember).strftime(STAMP) if held else None
        dropped = change.drop("seen", lambda x: limit is not None and (x["newest"] is None or x["newest"] < limit))
        change.note(stream, {"batch": number, "mark": held, "forgotten": bool(dropped) or base.notes.get(stream, {}).get("forgotten", False)})
    return True


def _older(store: Store, change: Change, fresh: DataFrame) -> DataFrame:
    buckets = [r[0] for r in fresh.select(change.bucket("content_hash")).distinct().collect()]  # a bounded number
    return store.read("articles", change.base, buckets).select(*KEY)


def _appended(change: Change, table: str, rows: DataFrame) -> None:
    """Rows beside those of their buckets, as folders of their own."""
    change._schema(table, rows)
    path = change._write(rows.withColumn("_bucket", change.bucket("hash_key")).repartition("_bucket"), table, True)
    change.new.tables[table] += [{"path": f"{path}/_bucket={b}", "bucket": b} for b in change._folders(path)]
    change.changed = True


def started(spark: SparkSession, path: str, store: Store, checkpoint: str, files_per_batch: int = 100, stream: str = "uploads", **how) -> StreamingQuery:
    """All uploads that lie as JSON files under ``path``, in batches; a query that is started again goes on where its checkpoint ends."""
    source = spark.readStream.schema(UPLOADS).option("maxFilesPerTrigger", files_per_batch).json(path)
    return source.writeStream.foreachBatch(lambda batch, number: apply_batch(store, batch, number, stream, **how) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
