"""The queries of this subpackage: thin digests of its operators over the whole of ``documents``, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, jaccard_join, langid, lexical, line_dedup, merkle, mixing, quality, secrets, sharding, simhash, token_counts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str, select: float = 0.5) -> DataFrame:
    """The documents that selection keeps: P(highest grade) >= ``select``. Grades: 0 toxic, 1 poor, 2 good."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = quality.fit(docs, labels, grade, grades=3)
    return quality.grade_documents(docs, model).where(F.col("tail_prob") >= select).withColumn("kept", F.lit(True))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("edits", token_counts.redactions())
    return token_counts.count_tokens(docs, vocabulary, "edits")


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    spans = secrets.as_text(F.array_sort(F.concat("base", "linked")))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.size("linked").cast("long").alias("n_linked"))


def op5_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.is_held_out("doc_id"))
    model = langid.fit(docs.where(~F.col("held_out")))
    found = langid.identify(docs, model, ["doc_id", "held_out"], spans=True)
    told = F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["lang"]))
    return found.withColumn("spans", F.array_join(told, ","))


def op8_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str, passage_words: int = 30) -> DataFrame:
    """Every line that repeats, whatever its length and wherever it stands, but the earliest occurrence of each; and beside them what
    lines cannot show, passages set in other lines: sentences in runs of ``passage_words`` or more that several texts hold; of these
    the earliest of each is told too (``removed`` is false). A sentence may lie in a line that goes."""
    docs = table(spark, sf_dir, "documents")
    lines = line_dedup.repeated_units(docs, min_words=1, kind="line", runs=True)
    sentences = line_dedup.repeated_units(docs, min_words=1, kind="sentence", run_words=passage_words, occurrences=True)
    return lines.withColumns({"kind": F.lit("line"), "removed": F.lit(True)}).unionByName(sentences.withColumn("kind", F.lit("sentence")))


def op10_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_repeats")).alias("taken"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.document_leaf(), offered=merkle.tampered_leaf()).drop("lang")


def op12_impact_search(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=k)


def op13_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ordinal_quality, op2_template_decontamination, op3_token_counts, op4_secret_links, op5_jaccard_classes, op6_exact_dedup, op7_language, op8_sampled_shards, op9_line_dedup, op10_flow_mix, op11_merkle_manifest, op12_impact_search, op13_simhash_ball)}
ORACLE = {"op6_exact_dedup": exact_dedup.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op10_flow_mix": mixing.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_impact_search": lexical.ORACLE}
