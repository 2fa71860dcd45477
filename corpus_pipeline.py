"""From raw documents to shards of a training corpus, in five stages; each works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import decontaminate, jaccard_join, langid, mixing, sharding
from quillspark.llm.common import saved, shared_dir, temporary


def whole(docs: DataFrame) -> Column:
    """A row's columns as one, so that no helper column meets another of its name."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null texts, those without letters, in unknown scripts or mostly in no
    one language go. Repeated rows and null ids are decided by their texts alone; an empty table gives no rows."""
    model = langid.fit(docs.where(~langid.is_held_out("doc_id")))
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))  # names that meet no other column
    found = langid.identify(plain, model, plain.columns, text_col=f"_{docs.columns.index('text')}")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id, null ids last. Documents without words all stay.

    Ids may repeat or be null, so rows are named by id and content. Rows that are one another's copies in full are a class
    as well, and one stays; an empty table gives no rows.
    """
    content = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"`{c}`").isNull() for c in docs.columns))
    keyed = docs.select(whole(docs), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), content.alias("content")).alias("key"), "text")
    near = jaccard_join.near_classes(keyed, id_col="key", count_links=False).where(F.col("key") == F.col("component_id"))
    name = {"none": F.col("key.none"), "id": F.coalesce(F.col("key.id").cast("string"), F.lit("")), "content": F.col("key.content")}
    first = saved(near.select(*(c.alias(x) for x, c in name.items()), (F.col("n_shingles") == 0).alias("blank")).distinct(), "kept-rows")
    once = Window.partitionBy(*name).orderBy("blank")
    return keyed.withColumns(name).join(first, list(name)).withColumn("nth", F.row_number().over(once)).where("nth = 1 OR blank").select("doc.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are named by id and text, so a clean text stays whatever else has its id, and
    rows without id are told apart; repeated rows go or stay together; null and empty texts stay."""
    keyed = docs.select(whole(docs), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text", F.col("text").isNull()).alias("text")).alias("key"), "text")
    found = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    hits = saved(found.select(F.col("key.id").alias("id"), F.col("key.text").alias("text")).distinct(), "hits")
    return keyed.join(hits, F.col("key.id").eqNullSafe(hits["id"]) & (F.col("key.text") == hits["text"]), "left_anti").select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null and empty texts have no words to take, and stay once if their source is taken
    at all; rows that repeat an id and text are taken alike; a null source is one like others; an empty table gives no rows."""
    mix = mixing.mix(docs.select(whole(docs), "doc_id", "text", "source")).where("mix_repeats > 0")
    return mix.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix_repeats"))).alias("again")).select("doc.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of every row, by equal bytes. Null texts count as empty, null ids as an id of their own; repeated rows are
    placed one by one, next to each other; an empty table gives no rows; other columns are not read."""
    return sharding.shard(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed), ("sharded", sharded)]

#: Language scores, hashed windows and digests have no counterpart in DuckDB; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
