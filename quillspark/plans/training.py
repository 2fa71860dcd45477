"""Preparation of question-answer training sets: reasons to reject, dedup in order of priority, leakage, sampling, order.

Random choices are ranks of salted digests, so they are the same on every run and machine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import feature_prompts
from quillspark.functions.prompts import message
from quillspark.functions.text import normal_map, normal_start, normalize
from quillspark.operators.order import numbered
from quillspark.operators.storage import saved
from quillspark.sources.files import write_array

#: Fixed value: the order in which types are cleaned; scarce types first.
PRIORITY = ("unanswerable", "text_entailment", "span_inference", "span_extraction")


def quotas(size: int, ratios: dict[str, float]) -> dict[str, int]:
    out = {k: round(size * r) for k, r in ratios.items()}
    if sum(out.values()) != size:
        raise ValueError(f"quotas add up to {sum(out.values())}, not {size}")
    return out


def salted(seed: str, *cols: str | Column) -> Column:
    return F.sha2(F.concat_ws("-", F.lit(seed), *cols).cast("binary"), 256)


def reject_reason(kind: Column, question: Column, answer: Column, start: Column, raw_context: Column, context: Column, norm_answer: Column, norm_start: Column) -> Column:
    """Why a record is left out; null for one that stays."""
    spoken = kind.isin("span_extraction", "span_inference")
    at = lambda text, i, what: F.substr(text, i + 1, F.length(what)) == what
    return (
        F.when(F.coalesce(question, F.lit("")) == "", "빈 질문")
        .when((kind == "text_entailment") & ~F.coalesce(answer.isin("Yes", "No"), F.lit(False)), "Yes/No 외 답")
        .when(spoken & (F.coalesce(answer, F.lit("")) == ""), "빈 답")
        .when(spoken & ~F.coalesce(at(raw_context, start, answer), F.lit(False)), "answer_start 위치 오류")
        .when(spoken & ~F.coalesce((norm_answer != "") & at(context, norm_start, norm_answer), F.lit(False)), "정규화 후 위치 불일치")
    )


def first_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_nth = 1").drop("_nth")


def by_priority(df: DataFrame, kinds: tuple[str, ...] = PRIORITY, kind: str = "question_type", order: str = "pos") -> DataFrame:
    """Each type in turn keeps its first record per context, then per doc_id, less all contexts and ids kept before.
    A missing id counts as one id (null-safe), as a set of seen values would. ``order`` is a column without repeats."""
    kept: DataFrame | None = None
    full, df = df, saved(df.select(order, kind, "doc_id", F.sha2(F.col("context").cast("binary"), 256).alias("context")))  # bodies stay behind
    for k in kinds:
        own = first_of(df.where(F.col(kind) == k), ["context"], order)
        if kept is not None:
            for c in ("context", "doc_id"):
                seen = kept.select(F.col(c).alias("_seen")).distinct()
                own = own.join(seen, own[c].eqNullSafe(seen["_seen"]), "left_anti")
        own = saved(first_of(own, ["doc_id"], order))  # it is read again for every later type
        kept = own if kept is None else kept.unionByName(own)
    return full.join(kept.select(order), order, "left_semi")


def without_leaks(train: DataFrame, held: DataFrame, keys: tuple[str, ...] = ("context", "doc_id")) -> DataFrame:
    """Two anti joins in turn; one join on either key would be a nested loop."""
    for c in keys:
        other = held.select(F.col(c).alias("_held")).distinct()
        train = train.join(other, train[c].eqNullSafe(other["_held"]), "left_anti")
    return train


def per_document(df: DataFrame, seed: str, k: int = 1, doc: str = "doc_id", id_col: str = "id") -> DataFrame:
    order = Window.partitionBy(doc).orderBy(salted(seed, id_col), id_col)
    return df.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k).drop("_nth")


def sample(df: DataFrame, n: int, seed: str, id_col: str = "id") -> DataFrame:
    """``n`` rows by salted digest; an error if there are fewer."""
    if df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return df.orderBy(salted(seed, id_col), id_col).limit(n)


def extract_required(df: DataFrame, n: int, seed: str, path: str, id_col: str = "id") -> DataFrame:
    """``n`` rows by salted digest, saved as an array file in order of id; an error if there are fewer."""
    out = saved(sample(df, n, seed, id_col), "required")
    write_array(out, path, [id_col])
    return out


def round_robin(df: DataFrame, n: int, seed: str, stratum: str, id_col: str = "id") -> DataFrame:
    """One of each stratum in turn until ``n``; strata and their rows in salted order."""
    inner = Window.partitionBy(stratum).orderBy(salted(seed, id_col), id_col)
    ranked = df.withColumn("_turn", F.row_number().over(inner)).where(F.col("_turn") <= n)
    return ranked.orderBy("_turn", salted(seed, stratum), stratum).limit(n).drop("_turn")


def balanced(df: DataFrame, n: int, seed: str, flag: Column, share: float = 0.5, id_col: str = "id") -> DataFrame:
    yes = round(n * share)
    return sample(df.where(flag), yes, seed, id_col).unionByName(sample(df.where(~flag), n - yes, seed, id_col))


def group_key(kind: Column, answer: Column) -> Column:
    """The group that order and checks go by: the type, for yes/no questions with the answer."""
    return F.when(kind == "text_entailment", F.concat(kind, F.lit(":"), F.coalesce(answer, F.lit("")))).otherwise(kind)


#: What the raw answers of a yes/no question are called, and the answer to a question that has none.
YES_NO, UNANSWERABLE = {"Yes": "예", "No": "아니오"}, "본문에서 답을 찾을 수 없습니다."


def records(raw: DataFrame) -> DataFrame:
    """Records of raw questions (id, question_type, question, raw_context, answer, answer_start, evidence): normalised, with the answer's
    place found again, and ``reason`` for those that are left out; null texts count as empty.
    """
    norm = lambda c: F.nullif(normalize(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    kind, spoken = F.col("question_type"), F.col("question_type").isin("span_extraction", "span_inference")
    full = raw.withColumns({"context": normalize(F.col("raw_context")), "new_question": F.coalesce(norm("question"), F.lit("")), "new_answer": F.coalesce(norm("answer"), F.lit("")), "new_evidence": norm("evidence")})
    full = full.withColumn("new_start", F.when(spoken, normal_start(normal_map(F.col("raw_context")), F.col("answer_start"))))
    reason = reject_reason(kind, F.col("new_question"), F.col("answer"), F.col("answer_start"), F.col("raw_context"), F.col("context"), F.col("new_answer"), F.col("new_start"))
    said = F.when(kind == "unanswerable", UNANSWERABLE).when(kind == "text_entailment", F.create_map(*[F.lit(x) for p in YES_NO.items() for x in p])[F.col("answer")]).otherwise(F.col("new_answer"))
    kept = lambda c: F.when(F.col("reason").isNull(), c)
    return full.withColumn("reason", reason).select(
        F.col("id").cast("string").alias("id"), "question_type", F.col("new_question").alias("question"), "context", kept(said).alias("answer"), kept(F.when(spoken, F.col("new_start"))).cast("int").alias("answer_start"),
        F.col("new_evidence").alias("evidence"), (kind == "unanswerable").alias("is_impossible"), "reason",
    )


def shuffled(df: DataFrame, seed: str, id_col: str = "id") -> DataFrame:
    """``pos``: each row's place in a seeded order."""
    return numbered(df.withColumn("_key", salted(seed, F.col(id_col).cast("string"))), ["_key", id_col], "pos").drop("_key")


def in_order(df: DataFrame, seed: str, group: str, id_col: str = "id") -> DataFrame:
    """``pos``: each row's place when all groups are spread evenly; rows of equal place stand in salted order."""
    placed = interleaved(df, seed, group, id_col).withColumn("_key", salted(f"{seed}-tie", F.col(id_col).cast("string")))
    return numbered(placed, ["place", "_key", id_col], "pos").drop("_key")


def interleaved(df: DataFrame, seed: str, group: str, id_col: str = "id") -> DataFrame:
    """place = (nth - 0.5) / size within the group: sorting by it spreads every group evenly."""
    nth = numbered(df.withColumn("_key", salted(seed, F.col(id_col).cast("string"))), ["_key", id_col], "_nth", 1, [group], "_size")
    return nth.withColumn("place", (F.col("_nth") - 0.5) / F.col("_size")).drop("_key", "_nth", "_size")


def replacements(removed: DataFrame, pool: DataFrame, seed: str, group: str = "grp", category: str = "category", depth: int = 16) -> DataFrame:
    """(removed_id, id): for each removed record, in order of id, the next free one of its group, of its category if possible, in salted
    order; an error if none is left.

    All removed records propose to the first of their list at once; a record that several want goes to the smallest id among them, and the
    others go on to their next - until no one is turned away. As every record prefers smaller ids, this ends where taking turns
    would end, whatever the number of records. Lists are ranked ``depth`` places deep, and four times deeper where one runs out.
    """
    kinds = dict(pool.dtypes)
    wanted = saved(removed.select(F.col("id").alias("removed_id"), F.col(group).alias("_g"), F.col(category).alias("_c")), "removed")
    key = F.sha2(F.concat_ws("-", F.lit(seed), F.lit("golden-replace"), "removed_id", "id").cast("binary"), 256)
    order = Window.partitionBy("removed_id").orderBy((F.col(category) != F.col("_c")).cast("int"), key)
    offered = pool.select("id", F.col(group).alias("_of"), category)
    places = wanted.select("removed_id", F.lit(1).alias("at"))
    sizes = offered.groupBy("_of").agg(F.count("*").alias("size"))
    most = wanted.join(sizes, F.col("_g") == F.col("_of"), "left").agg(F.max("size"), F.count_if(F.col("size").isNull())).first()
    ranked = None
    while True:
        if ranked is None:
            if most[1]:
                raise ValueError(f"{most[1]} records have no replacement")
            ranked = offered.join(wanted, F.col("_of") == F.col("_g")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= depth).select("removed_id", "id", "nth")
            ranked = saved(ranked, "ranked")
        asked = saved(places.join(ranked, (places["removed_id"] == ranked["removed_id"]) & (F.col("at") == F.col("nth")), "left").select(places["removed_id"], "at", "id"), "proposals")
        short = asked.where("id IS NULL").count()
        if short:  # a list has run out
            if depth >= most[0]:
                raise ValueError(f"{short} records have no replacement")
            depth, ranked = 4 * depth, None
            continue
        taken = asked.groupBy("id").agg(F.min("removed_id").alias("by"))
        judged = asked.join(taken, "id").select("removed_id", "at", "id", (F.col("removed_id") == F.col("by")).alias("kept"))
        judged = saved(judged, "judged")
        if not judged.where("NOT kept").head(1):
            return judged.select(F.col("removed_id").cast(kinds["id"]).alias("removed_id"), "id")
        places = judged.select("removed_id", F.when(F.col("kept"), F.col("at")).otherwise(F.col("at") + 1).alias("at"))


def shared_records(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of ``a`` that stand in ``b`` as a whole."""
    return a.withColumn("_w", whole_record(a)).join(b.select(whole_record(b).alias("_w")), "_w", "left_semi").drop("_w")


def whole_record(df: DataFrame) -> Column:
    """The digest of a record's JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256)


def less_records(df: DataFrame, held: DataFrame) -> DataFrame:
    """Anti join on whole records, by the digest of their JSON with sorted keys."""
    return df.withColumn("_w", whole_record(df)).join(held.select(whole_record(held).alias("_w")), "_w", "left_anti").drop("_w")


def summary_sets(df: DataFrame, n: int, golden: int, seed: str, id_col: str = "id") -> DataFrame:
    """The training sample and a golden sample of what is left, marked by ``split``. Whole records decide what is left, so a
    repeat of a training record never turns golden."""
    train = sample(df, n, f"{seed}-train", id_col)
    rest = sample(less_records(df, train), golden, f"{seed}-golden", id_col)
    return train.withColumn("split", F.lit("train")).unionByName(rest.withColumn("split", F.lit("golden")))


def examples(df: DataFrame, system: str) -> DataFrame:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    ask = F.concat(F.lit("본문: "), F.col("context"), F.lit("\n질문: "), F.col("question"))
    return df.select(F.array(turn("system", F.lit(system)), turn("user", ask)).alias("prompt"), F.array(turn("assistant", F.col("answer"))).alias("completion"))


def summary_example(passage: Column, summary: Column) -> tuple[Column, Column]:
    """(prompt, completion) of the summary adapter; the prompt is the one that the feature uses."""
    return feature_prompts.messages("summary", passage=passage), F.array(message("assistant", F.coalesce(summary, F.lit(""))))


def answer_example(context: Column, question: Column, answer: Column) -> tuple[Column, Column]:
    """(prompt, completion) of the question adapter; the prompt is the one that the feature uses."""
    return feature_prompts.messages("qa", context=context, question=question), F.array(message("assistant", F.coalesce(answer, F.lit(""))))


def observed_stages(df: DataFrame, stages: Sequence[tuple[str, Column, Sequence[str]]]) -> tuple[DataFrame, list[tuple[str, Sequence[str], Observation]]]:
    """What is left of ``df`` after all stages, and observations of how many rows each left out for which reason, and kept.

    A stage is (name, reason, reasons): a column that is null for a row that stays, and the values it may have. The counts are
    taken from the rows as they pass, so they cost no scan of their own; they are there once an action has run.
    """
    seen = []
    for name, reason, reasons in stages:
        df = df.withColumn("_reason", reason)
        watch = Observation()
        told = [F.count_if(F.col("_reason") == r).alias(f"r{i}") for i, r in enumerate(reasons)]
        df = df.observe(watch, F.count("*").alias("seen"), F.count_if(F.col("_reason").isNull()).alias("kept"), *told).where("_reason IS NULL").drop("_reason")
        seen.append((name, reasons, watch))
    return df, seen


def stage_counts(spark: SparkSession, seen: list[tuple[str, Sequence[str], Observation]]) -> DataFrame:
    """(stage, reason, n) of observations whose plan has run; a null reason for rows that stayed. A reason that was not named is an error."""
    rows = []
    for name, reasons, watch in seen:
        held = watch.get
        if held["seen"] != held["kept"] + sum(held[f"r{i}"] for i in range(len(reasons))):
            raise ValueError(f"{name} has a reason that was not named")
        rows += [(name, None, held["kept"]), *((name, r, held[f"r{i}"]) for i, r in enumerate(reasons))]
    return spark.createDataFrame([r for r in rows if r[2]], "stage string, reason string, n long")


def run_stages(df: DataFrame, stages: Sequence[tuple[str, Column, Sequence[str]]], write: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The counts of all stages from one pass, which ``write`` uses for the rows that are left (default: they go nowhere).

    Counts of a pass without a shuffle hold whatever is lost: a task's numbers count when it is done, once. Behind a shuffle whose
    outputs are lost rows pass again and are counted again, so stages stand before the first shuffle, or after a saved table.
    """
    out, seen = observed_stages(df, stages)
    (write or (lambda x: x.write.format("noop").mode("overwrite").save()))(out)
    return stage_counts(df.sparkSession, seen)
