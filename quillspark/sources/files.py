"""Readers and writers: uploads by kind, nested corpora, web results, arrays of JSON, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import strip
from quillspark.operators.order import numbered
from quillspark.operators.storage import saved

#: What each file ending is read as; the largest upload.
TEXT, IMAGE, PDF = ("txt", "md"), ("png", "jpg", "jpeg"), ("pdf",)
LARGEST = 20 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind_of(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*TEXT), "text").when(e.isin(*IMAGE), "image").when(e.isin(*PDF), "pdf")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, error and, for text files, the decoded text; the size is tested on metadata alone."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind, error = kind_of(F.col("path")), upload_error(F.col("path"), F.col("length"), F.col("content"))
    return raw.select("path", kind.alias("kind"), error.alias("error"), F.when(error.isNull() & (kind == "text"), decoded(F.col("content"))).alias("text"))


def upload_error(path: Column, length: Column, content: Column) -> Column:
    """Why an upload is refused: its ending, its size in bytes, or text that is no UTF-8; null if it is taken."""
    kind = kind_of(path)
    return F.when(kind.isNull(), "unsupported format").when(length > LARGEST, "too large").when((kind == "text") & ~F.is_valid_utf8(content.cast("string")), "invalid file")


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text: without a byte-order mark, with plain line ends, stripped."""
    return strip(F.replace(F.regexp_replace(content.cast("string"), "^﻿", ""), F.lit("\r\n"), F.lit("\n")))


QA = "data array<struct<doc_id:string,doc_title:string,doc_source:string,doc_published:string,doc_class:map<string,string>,paragraphs:array<struct<context:string,qas:array<struct<question_id:string,question:string,answers:struct<text:string,answer_start:int,clue_text:string>>>>>>>"


def qa_corpus(spark: SparkSession, path: str, split: str, kind: str) -> DataFrame:
    """One row per question of a nested corpus, with its place in the file."""
    return questions(spark.read.option("multiLine", True).schema(QA).json(path), split, kind)


def questions(raw: DataFrame, split: str, kind: str) -> DataFrame:
    docs = raw.select(F.posexplode("data").alias("doc_pos", "d"))
    paragraphs = docs.select("doc_pos", "d", F.posexplode("d.paragraphs").alias("par_pos", "p"))
    return paragraphs.select(
        "doc_pos", "par_pos", F.posexplode("p.qas").alias("qa_pos", "q"), F.col("p.context").alias("raw_context"), F.col("d.doc_id").alias("doc_id"), F.col("d.doc_title").alias("doc_title"), F.col("d.doc_class").alias("doc_class")
    ).select("doc_pos", "par_pos", "qa_pos", F.lit(split).alias("source_split"), F.lit(kind).alias("question_type"), "doc_id", "doc_title", "doc_class", "raw_context", F.col("q.question_id").alias("id"), "q.question", "q.answers")


def summary_corpus(spark: SparkSession, path: str) -> DataFrame:
    """All JSON files below a folder, arrays or single objects; unreadable ones are left out; two of three summaries go."""
    schema = "`Meta(Refine)` struct<passage:string,passage_id:string>, Annotation struct<summary1:string,summary2:string,summary3:string>, _corrupt_record string"
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema).json(path)
    return summaries(raw)


def summaries(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("`Meta(Refine)`").isNotNull()).select(F.col("`Meta(Refine)`"), F.col("Annotation").dropFields("summary1", "summary2").alias("Annotation"))


def head_of(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    return df.orderBy(pos).limit(n)


def web_results(df: DataFrame, n: int = 5, most: int = 500) -> DataFrame:
    """Results with address and content, in rank order; the address stands in for a missing title."""
    ok = df.where("url IS NOT NULL AND url <> '' AND content IS NOT NULL AND content <> ''")
    return ok.select("rank", F.coalesce(F.nullif(F.col("title"), F.lit("")), "url").alias("title"), "url", F.left("content", F.lit(most)).alias("content")).orderBy("rank").limit(n)


def web_context(df: DataFrame) -> DataFrame:
    held = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("\n", "title", "content").alias("t")))), lambda x: x["t"])
    return df.agg(F.array_join(held, "\n\n").alias("context"))


def write_rows(df: DataFrame, path: str, pos: str = "pos", kind: str | None = None) -> DataFrame | None:
    """JSON rows with their position: files have no order of their own. With ``kind``, how many rows of each there are."""
    df.sortWithinPartitions(pos).write.mode("overwrite").json(path)
    return None if kind is None else per_kind(df.sparkSession.read.schema(df.schema).json(path), kind)


def write_array(df: DataFrame, path: str, order: list[str], rows_per_file: int = 1_000_000) -> None:
    """A JSON array in files: read one after the other by name they are one array, in order; up to ``rows_per_file`` rows are one file, an
    array by itself. Null fields are written. An empty table gives an empty array; nothing is gathered in the driver."""
    n = df.count()
    if not n:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    if n <= rows_per_file:  # one file: its rows stand in one partition
        placed = df.repartition(1).sortWithinPartitions(*(F.col(f"`{c}`").asc_nulls_first() for c in order)).withColumn("_nth", F.monotonically_increasing_id())
    else:
        placed = numbered(df, order, "_nth")
    line = F.concat(F.when(F.col("_nth") == 0, "[").otherwise(""), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), F.when(F.col("_nth") == n - 1, "]").otherwise(","))
    lines = placed.select("_nth", line.alias("value"))
    lines = lines if n <= rows_per_file else lines.repartitionByRange(-(-n // rows_per_file), "_nth").sortWithinPartitions("_nth")
    lines.select("value").write.mode("overwrite").text(path)


def save_results(sets: dict[str, DataFrame], folder: str, order: list[str], kind: str) -> DataFrame:
    """Every set as an array file ``<name>.json`` below ``folder``; (name, kind, n) of what they hold."""
    counts = []
    for name, df in sets.items():
        df = saved(df, name)
        write_array(df, f"{folder}/{name}.json", order)
        counts.append(per_kind(df, kind).select(F.lit(name).alias("name"), kind, "n"))
    return reduce(DataFrame.unionByName, counts)


def per_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"))


def file_errors(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(rule, split, id, message): splits whose file is missing or empty, is no JSON, or holds no array. Nothing raises."""
    from pyspark.errors import AnalysisException

    out = spark.createDataFrame([], "rule string, split string, id string, message string")
    for split, path in paths.items():
        try:
            raw = spark.read.text(path, wholetext=True)
            held = raw.where("length(value) > 0").agg(F.max("value").alias("value"))
        except AnalysisException:
            held = spark.createDataFrame([(None,)], "value string")
        out = out.unionByName(held.select(F.lit("file").alias("rule"), F.lit(split).alias("split"), F.lit(None).cast("string").alias("id"), file_problem(F.col("value")).alias("message")).where("message IS NOT NULL"))
    return out


def file_problem(content: Column) -> Column:
    """What is wrong with the content of a file that should be a JSON array; null for nothing."""
    kind = F.schema_of_variant(F.try_parse_json(content))
    return F.when(F.coalesce(content, F.lit("")) == "", "missing or empty").when(kind.isNull(), "not JSON").when(~kind.startswith("ARRAY"), "not an array")


def snapshot(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
