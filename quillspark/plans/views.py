"""The archive's tables as views over the star-schema test tables, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOW = "1998-06-17 01:00:00"  # the fixed present of period queries (local time)

SQL = """
organizations AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation),
users AS (SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS organization_id, s_name AS nickname, CASE WHEN s_suppkey % 10 = 0 THEN 'admin' ELSE 'member' END AS role FROM supplier),
user_articles AS (SELECT DISTINCT l_suppkey AS user_id, l_orderkey AS article_id FROM lineitem),
articles AS (SELECT o_orderkey AS id, concat('order-', CAST(o_orderkey AS VARCHAR)) AS title, nullif(o_orderpriority, '4-NOT SPECIFIED') AS category,
    CASE WHEN o_orderstatus = 'F' THEN 'public' ELSE 'private' END AS visibility, o_orderdate AS published_at, o_custkey AS author_id FROM orders),
messages AS (SELECT conv_id AS conversation_id, turn AS id, role, text AS content FROM conversations),
article_chunks AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS article_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_index, embedding FROM embeddings),
chunk_owners AS (SELECT s_suppkey AS user_id, s_suppkey % 10 AS article_id FROM supplier)
"""


class Archive:
    """Lazy views; every operator prunes what it does not need."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def organizations(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))

    @property
    def users(self) -> DataFrame:
        role = F.when(F.col("s_suppkey") % 10 == 0, "admin").otherwise("member")
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("organization_id"), F.col("s_name").alias("nickname"), role.alias("role"))

    @property
    def user_articles(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("article_id")).distinct()

    @property
    def links(self) -> DataFrame:
        """user_articles with repeats: for uses that only ask whether a link exists."""
        return self.raw("lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("article_id"))

    @property
    def articles(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("title"),
            F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("category"),
            F.when(F.col("o_orderstatus") == "F", "public").otherwise("private").alias("visibility"),
            F.col("o_orderdate").alias("published_at"),
            F.col("o_custkey").alias("author_id"),
        )

    @property
    def messages(self) -> DataFrame:
        return self.raw("conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))

    @property
    def chunks(self) -> DataFrame:
        order = Window.partitionBy("label").orderBy("vec_id")
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("article_id"), (F.row_number().over(order) - 1).cast("long").alias("chunk_index"), "embedding")

    @property
    def chunk_owners(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") % 10).alias("article_id"))
