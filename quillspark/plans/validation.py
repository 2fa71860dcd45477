"""Validation of prepared sets: each rule gives rows (rule, split, id, message); the report counts them."""

from __future__ import annotations

from itertools import combinations
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import problems
from quillspark.operators.order import at_ranks, counted, first_per_key, same

#: Rules in the order of the report.
RULES = ("file", "fields", "type", "counts", "duplicates", "overlap", "source", "normalization", "segments")


def _error(rule: str, id_col: Column, message: Column, split: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), split.alias("split"), id_col.cast("string").alias("id"), message.alias("message")]


def type_rules(df: DataFrame, unanswerable: str, yes: str = "예", no: str = "아니오") -> DataFrame:
    kind, impossible, start = F.col("question_type"), F.col("is_impossible"), F.col("answer_start")
    spoken = kind.isin("span_extraction", "span_inference")
    at = F.coalesce(F.substr(F.col("context"), start + 1, F.length("answer")) == F.col("answer"), F.lit(False))
    found = F.array_compact(F.array(
        F.when(spoken & ~at, "answer not at answer_start"), F.when(spoken & impossible, "span but impossible"),
        F.when((kind == "text_entailment") & ~F.col("answer").isin(yes, no), "answer is neither yes nor no"), F.when((kind == "text_entailment") & (start.isNotNull() | impossible), "yes/no with a start or impossible"),
        F.when((kind == "unanswerable") & (F.col("answer") != unanswerable), "not the unanswerable sentence"), F.when((kind == "unanswerable") & (start.isNotNull() | ~impossible), "unanswerable with a start or possible"),
    ))
    return df.select("split", "id", F.explode(found).alias("m")).select(*_error("type", F.col("id"), F.col("m"), F.col("split")))


def duplicates(df: DataFrame, keys: tuple[str, ...] = ("id", "context")) -> DataFrame:
    """An error for every repeat after the first."""
    out = []
    for k in keys:
        nth = F.row_number().over(Window.partitionBy("split", k).orderBy("pos"))
        out.append(df.withColumn("_nth", nth).where("_nth > 1").select(*_error("duplicates", F.col("id"), F.lit(f"{k} repeats"), F.col("split"))))
    return reduce(DataFrame.unionByName, out)


def overlaps(splits: dict[str, DataFrame], keys: tuple[str, ...] = ("id", "doc_id", "context")) -> DataFrame:
    out = []
    for (a, x), (b, y) in combinations(splits.items(), 2):
        for k in keys:
            both = x.select(k).intersect(y.select(k))
            out.append(both.agg(F.count("*").alias("n")).select(F.lit(f"{a}/{b}").alias("pair"), F.lit(k).alias("key"), "n"))
    return reduce(DataFrame.unionByName, out)


def normalization(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("t")) for f in fields])).alias("x")
    return df.select("split", "id", each).select("split", "id", F.col("x.f").alias("f"), F.explode(problems(F.col("x.t"))).alias("p")).select(*_error("normalization", F.col("id"), F.concat_ws(": ", "f", "p"), F.col("split")))


def segments(df: DataFrame, size: int, group: str, pos: str = "pos") -> DataFrame:
    """Groups that stray by more than 1 from their even share in a segment of ``size`` rows; absent groups count as 0."""
    seg = df.select(F.floor(F.col(pos) / size).cast("long").alias("segment"), F.col(group).alias("grp"))
    n = seg.groupBy("segment", "grp").agg(F.count("*").alias("n"))
    per_seg = n.groupBy("segment").agg(F.sum("n").alias("rows"))
    per_grp = n.groupBy("grp").agg(F.sum("n").alias("of"))
    total = n.agg(F.sum("n").alias("total"))
    # an absent group can only stray if its share of a full segment is over 1: fewer than ``size`` groups
    often = per_grp.crossJoin(F.broadcast(total)).where(F.col("of") * size > F.col("total")).select("grp")
    grid = per_seg.select("segment").crossJoin(F.broadcast(often)).unionByName(n.select("segment", "grp")).distinct()
    full = grid.join(n, ["segment", "grp"], "left").join(per_seg, "segment").join(per_grp, "grp").crossJoin(F.broadcast(total))
    return full.select("segment", "grp", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.col("of") * F.col("rows") / F.col("total")).alias("share")).where(F.abs(F.col("n") - F.col("share")) > 1)


def quartiles(df: DataFrame, value: str, group: str, values: DataFrame | None = None) -> DataFrame:
    """Quartiles by the exclusive method: i(n+1)/4 between neighbours in rank, found by counts in buckets, so no group is sorted.
    Groups of under 2 rows give none; null values are left out. ``values``: ``order.counted`` of the same, where it is at hand."""
    values = counted(df, value, group) if values is None else values
    sizes = values.groupBy("grp").agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")).where("n >= 2")
    i = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i")
    spots = sizes.select("grp", "n", i).withColumn("j", F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("i") * (F.col("n") + 1) / 4))).cast("long"))
    spots = spots.withColumn("d", F.col("i") * (F.col("n") + 1) - 4 * F.col("j"))
    parts = spots.select("grp", "i", F.explode(F.array(F.struct(F.col("j").alias("rank"), (4 - F.col("d")).alias("w")), F.struct((F.col("j") + 1).alias("rank"), F.col("d").alias("w")))).alias("x")).select("grp", "i", "x.*")
    found = at_ranks(values, parts.select("grp", "rank")).select(F.col("grp").alias("g"), F.col("rank").alias("r"), "v")
    cut = parts.join(found, same([parts["grp"], parts["rank"]], [found["g"], found["r"]])).groupBy(parts["grp"].alias("q"))
    cut = cut.agg(*(F.sum(F.when(F.col("i") == x, F.col("v") * F.col("w")) / 4).alias(f"q{x}") for x in (1, 2, 3)))
    return sizes.join(cut, F.col("grp").eqNullSafe(F.col("q"))).select("grp", "q1", "q2", "q3", "least", "most", "mean", "n")


def outliers(df: DataFrame, value: str, group: str) -> DataFrame:
    """(grp, n_outliers): rows beyond 1.5 times the range between quartiles, of groups of 4 or more rows; a null group gives none."""
    values = counted(df, value, group)
    q = quartiles(df, value, group, values).where("n >= 4").withColumnRenamed("grp", "of")
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return values.join(q, F.col("grp") == F.col("of")).where((F.col("v") < low) | (F.col("v") > high)).groupBy("grp").agg(F.sum("c").alias("n_outliers"))


def report(errors: DataFrame, examples: int = 5) -> DataFrame:
    """(place, rule, n, examples): each rule's number of errors and the messages of the first ones by split, id and message. Every task keeps
    ``examples`` rows a rule, so a rule that half of all rows break is no task's burden."""
    got = first_per_key(errors, "rule", ["split", "id", "message"], examples).select(F.col("rule"), "n", F.transform("firsts", lambda x: x["message"]).alias("examples"))
    all_ = errors.sparkSession.createDataFrame(list(enumerate(RULES)), "place int, rule string")
    return all_.join(got, "rule", "left").select("place", "rule", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "examples")


def length_report(df: DataFrame, text: str, limit: int) -> DataFrame:
    """Rows, mean and longest length in words (the tokenizer's stand-in) and the share in percent over ``limit``; null is empty."""
    n = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))).cast("long")
    words = df.select(n.alias("k"))
    return words.agg(F.count("*").alias("n"), F.avg("k").alias("mean"), F.max("k").alias("longest"), (F.lit(100.0) * F.count_if(F.col("k") > limit) / F.count("*")).alias("share_over"))


def counts(df: DataFrame, expected: dict[tuple[str, str], int]) -> DataFrame:
    """An error for every (split, type) whose number of rows is not the expected one, absent and unexpected types included."""
    want = df.sparkSession.createDataFrame([(s, t, n) for (s, t), n in expected.items()], "split string, question_type string, want long")
    got = df.groupBy("split", "question_type").agg(F.count("*").alias("n"))
    both = want.join(got, ["split", "question_type"], "full_outer").na.fill(0, ["want", "n"]).where("want <> n")
    return both.select(*_error("counts", F.lit(None), F.concat(F.col("question_type"), F.lit(": "), F.col("n").cast("string"), F.lit(" of "), F.col("want").cast("string")), F.col("split")))


def review_sample(df: DataFrame, n: int, seed: str, id_col: str = "id") -> DataFrame:
    """``n`` rows of each split and type for reading, by a seeded digest: the report's feature, not a cap."""
    key = F.sha2(F.concat_ws("-", F.lit(seed), F.lit("review"), "split", "question_type", F.col(id_col).cast("string")), 256)
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy("split", "question_type").orderBy(key, id_col))).where(F.col("_nth") <= n).drop("_nth")


#: The fields of a record, what JSON kinds each may have, and the keys of its metadata.
FIELDS = {
    "id": ("string",), "question_type": ("string",), "question": ("string",), "context": ("string",), "answer": ("string",),
    "answer_start": ("integer", "null"), "evidence": ("string", "null"), "is_impossible": ("boolean",), "metadata": ("object",),
}
METADATA = ("doc_id", "doc_title", "source", "published", "category", "source_split")


def json_kind(value: Column) -> Column:
    """string, integer, number, boolean, null, object or array of a variant; null if there is none."""
    of = F.schema_of_variant(value)
    return F.when(of == "VOID", "null").when(of == "BIGINT", "integer").when(of.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(of.startswith("OBJECT"), "object").when(of.startswith("ARRAY"), "array").otherwise(F.lower(of))


def json_problems(record: Column, fields: dict[str, tuple[str, ...]], parts: dict[str, tuple[str, ...]] | None = None) -> Column:
    """What is wrong with a JSON text: not an object, or fields that are missing, of another kind, or blank; then keys
    that are missing in a field that is an object (``parts``). Null counts as not an object."""
    v = F.try_parse_json(record)
    found = []
    for name, kinds in fields.items():
        value = F.try_variant_get(v, f"$.{name}", "variant")
        text = F.when(json_kind(value) == "string", F.try_variant_get(v, f"$.{name}", "string"))
        found.append(F.when(value.isNull(), f"{name} missing").when(~json_kind(value).isin(*kinds), f"{name} of another kind").when(text.rlike(r"^(?U)\s*$"), f"{name} blank"))
    for name, keys in (parts or {}).items():
        inner = json_kind(F.try_variant_get(v, f"$.{name}", "variant")) == "object"
        found += [F.when(inner & F.try_variant_get(v, f"$.{name}.{k}", "variant").isNull(), f"{name}.{k} missing") for k in keys]
    return F.when(F.coalesce(json_kind(v) == "object", F.lit(False)), F.array_compact(F.array(*found))).otherwise(F.array(F.lit("not an object")))


def field_rules(df: DataFrame, kinds: tuple[str, ...], record: str = "record") -> DataFrame:
    """Errors of raw JSON records (split, pos, record), one a record; only records without any go on to the other rules."""
    wrong = json_problems(F.col(record), FIELDS, {"metadata": METADATA})
    kind = F.try_variant_get(F.try_parse_json(F.col(record)), "$.question_type", "string")
    wrong = F.when(F.get(wrong, F.lit(0)).eqNullSafe(F.lit("not an object")) | F.coalesce(kind.isin(*kinds), F.lit(False)), wrong).otherwise(F.concat(wrong, F.array(F.concat(F.lit("unknown question_type: "), F.coalesce(kind, F.lit("null"))))))
    name = F.coalesce(F.try_variant_get(F.try_parse_json(F.col(record)), "$.id", "string"), F.concat(F.lit("#"), F.col("pos").cast("string")))
    return df.select("split", name.alias("id"), wrong.alias("w")).where(F.size("w") > 0).select(*_error("fields", F.col("id"), F.array_join("w", ", "), F.col("split")))


def source_rules(df: DataFrame, expected: dict[str, str], source: str = "source_split") -> DataFrame:
    """Records whose source is not the one of their split; a split without expectation is wrong throughout."""
    want = F.coalesce(*[F.when(F.col("split") == s, F.lit(x)) for s, x in expected.items()]) if expected else F.lit(None).cast("string")
    message = F.concat(F.lit("source "), F.coalesce(F.col(source), F.lit("null")), F.lit(" instead of "), F.coalesce(want, F.lit("none")))
    return df.where(~F.coalesce(F.col(source) == want, F.lit(False))).select(*_error("source", F.col("id"), message, F.col("split")))


def excluded(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose id (ids: id) was to be left out."""
    return df.join(ids.select("id").distinct(), "id", "left_semi").select(*_error("overlap", F.col("id"), F.lit("excluded id is present"), F.col("split")))


def ratios(df: DataFrame, expected: dict[str, int], shares: dict[str, dict[str, float]], yes_share: float, yes: str = "예", tolerance: float = 0.0) -> DataFrame:
    """Errors of splits whose number of rows, share of a type, or share of yes among yes/no answers is not the expected one.

    ``expected``: rows of each split; ``shares``: share of each type by split; shares may stray by ``tolerance``.
    """
    spark = df.sparkSession
    got = df.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("question_type") == "text_entailment").alias("asked"), F.count_if((F.col("question_type") == "text_entailment") & (F.col("answer") == yes)).alias("yes"))
    want = spark.createDataFrame(list(expected.items()), "split string, want long")
    both = want.join(got, "split", "left").na.fill(0, ["n", "asked", "yes"])
    size = both.where("n <> want").select(*_error("counts", F.lit(None), F.concat(F.lit("rows: "), F.col("n").cast("string"), F.lit(" of "), F.col("want").cast("string")), F.col("split")))
    told = both.where((F.col("asked") > 0) & (F.abs(F.col("yes") - F.round(F.col("asked") * yes_share)) > tolerance * F.col("asked")))
    told = told.select(*_error("counts", F.lit(None), F.concat(F.lit("yes: "), F.col("yes").cast("string"), F.lit(" of "), F.round(F.col("asked") * yes_share).cast("long").cast("string")), F.col("split")))
    share = spark.createDataFrame([(s, t, float(x)) for s, held in shares.items() for t, x in held.items()], "split string, question_type string, share double")
    types = df.groupBy("split", "question_type").agg(F.count("*").alias("k"))
    off = share.join(types, ["split", "question_type"], "left").na.fill(0, ["k"]).join(both.select("split", "n"), "split").where(F.abs(F.col("k") - F.round(F.col("n") * F.col("share"))) > tolerance * F.col("n"))
    off = off.select(*_error("counts", F.lit(None), F.concat(F.col("question_type"), F.lit(": "), F.col("k").cast("string"), F.lit(" of "), F.round(F.col("n") * F.col("share")).cast("long").cast("string")), F.col("split")))
    return size.unionByName(told).unionByName(off)


def distribution(df: DataFrame, value: str, pos: str = "pos", group: str = "split") -> DataFrame:
    """(group, value, n, nth): how often each value stands in a group, most frequent first, equal ones as first seen."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(pos).alias("_first"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "_first")
    return n.select(group, value, "n", F.row_number().over(order).cast("long").alias("nth"))
