"""Company questions, all at once: each question's call is read, checked or replaced by rules, run, and told as a sentence.

Equal requests of one organisation run once. Counts come from articles aggregated by period and attributes before they meet
the requests, and lists from the newest articles of each period and category, so a large organisation's rows are not repeated a request.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import parsers
from quillspark.functions.periods import PERIOD_LABELS, UNCATEGORIZED, bounds, first_match
from quillspark.functions.text import strip

from . import order
from .archive import article_date, holders, only_organization

KEYS = ["organization_id", "name", "period", "category", "author", "media"]
RECENT, TITLES = 5, 20  # the features' own limits
NOT_FOUND = "관련 내용을 찾지 못했습니다."  # fixed value


def routed(questions: DataFrame) -> DataFrame:
    """Adds name, period, category, author and media: the model's call (``raw``) where it may run, else the keyword rules."""
    call = parsers.checked_call(parsers.tool_call(F.col("raw")), F.col("question"))
    read = questions.withColumn("_call", call).withColumn("_rule", parsers.fallback_call(F.col("question")))
    usable = F.col("_call").isNotNull()
    said = lambda key: F.when(usable, F.col("_call.arguments")[key])
    return read.select(
        *questions.columns,
        F.when(usable, F.col("_call.name")).otherwise(F.col("_rule.name")).alias("name"),
        F.when(usable, said("period")).otherwise(F.col("_rule.period")).alias("period"),
        F.when(usable, said("category")).otherwise(F.col("_rule.category")).alias("category"),
        said("author").alias("author"),
        said("media").alias("media"),
    )


def _periods(at: Column, now: datetime) -> Column:
    """The periods that a time lies in, a bit each; a missing one lies in ``all``."""
    inside = lambda span: F.lit(True) if span is None else (at >= F.lit(span[0].isoformat(sep=" ")).cast("timestamp_ntz")) & (at < F.lit(span[1].isoformat(sep=" ")).cast("timestamp_ntz"))
    return reduce(Column.__add__, [F.when(inside(bounds(p, now)), 1 << i).otherwise(0) for i, p in enumerate(PERIOD_LABELS)])


def _by_period(rows: DataFrame) -> DataFrame:
    """A row for each period of ``periods``, as ``own_period``."""
    named = F.array(*[F.when(F.col("periods").bitwiseAND(1 << i) != 0, p) for i, p in enumerate(PERIOD_LABELS)])
    return rows.withColumn("own_period", F.explode(named)).where("own_period IS NOT NULL").drop("periods")


def _numbered(head: str, found: Column, tail: str, empty: str) -> Column:
    held = F.concat(F.lit(head), F.size(found).cast("string"), F.lit(tail + "\n"), parsers.numbered_text(found))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, held).otherwise(empty)


def _first_titles(table: DataFrame, name: str) -> DataFrame:
    held = F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"])
    return titles_of(table).groupBy("organization_id").agg(held.alias(name))


def run(requests: DataFrame, articles: DataFrame, links: DataFrame, users: DataFrame, templates: DataFrame, guidelines: DataFrame, now: datetime) -> DataFrame:
    """(ask, answer) of distinct requests (KEYS and ``ask``, a key of their own)."""
    at = article_date(articles).cast("timestamp_ntz")
    orgs = requests.select("organization_id").distinct()
    held = holders(links, users.join(orgs, "organization_id", "left_semi"))
    scope = articles.select("id", "title", at.alias("at"), F.col("category").alias("own_category"), F.col("author").alias("own_author"), F.col("media").alias("own_media")).join(held.withColumnRenamed("article_id", "id"), "id")
    # an article counts in each period that it lies in, so a request meets the rows of its own period alone; few sets of periods occur, so
    # articles are counted and ranked by set, and only what is left is told by period
    dated = scope.withColumn("periods", _periods(F.col("at"), now))
    sums = _by_period(dated.groupBy("organization_id", "periods", "own_category", "own_author", "own_media").agg(F.count("*").alias("n")))

    fits = F.col("category").isNull() | (F.col("own_category") == F.col("category"))
    named = (F.col("author").isNull() | F.contains("own_author", "author")) & (F.col("media").isNull() | F.contains("own_media", "media"))
    counted = requests.where(F.col("name").startswith("count_articles")).join(sums.withColumnRenamed("own_period", "period"), ["organization_id", "period"]).where(fits & named)
    by = counted.groupBy("ask", "own_category").agg(F.sum("n").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.coalesce("own_category", F.lit(UNCATEGORIZED)).alias("c")))), lambda x: F.concat(F.lit("- "), x["c"], F.lit(": "), (-x["n"]).cast("string"), F.lit("건")))
    counts = by.groupBy("ask").agg(F.sum("n").alias("n"), F.array_join(lines, "\n").alias("lines"))

    # the newest of each period and category (null: of all) first, so a request meets no more than it tells
    slot = Window.partitionBy("organization_id", "own_period", "slot").orderBy(F.desc_nulls_last("at"), F.desc("id"))
    least = order.last_rows(dated.select("organization_id", "periods", "own_category", "at", "id", "title"), ["organization_id", "periods", "own_category"], ["at", "id"], RECENT, "nth")
    slots = _by_period(least).withColumn("slot", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.col("own_category")))))
    latest = slots.withColumn("nth", F.row_number().over(slot)).where(F.col("nth") <= RECENT).select(F.col("organization_id").alias("org"), "own_period", "slot", "id", "title", "at", "nth")
    asked = requests.where(F.col("name") == "list_recent_articles")
    newest = asked.join(latest, (F.col("organization_id") == F.col("org")) & (F.col("period") == F.col("own_period")) & F.col("category").eqNullSafe(F.col("slot"))).select("ask", "id", "title", "at", "nth")
    line = F.concat("title", F.lit(" ("), F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("날짜 없음")), F.lit(")"))
    recent = newest.groupBy("ask").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("l")))), lambda x: x["l"]).alias("recent"))

    members = users.groupBy("organization_id").agg(F.count("*").alias("members"))
    known = requests.join(counts, "ask", "left").join(recent, "ask", "left").join(members, "organization_id", "left")
    known = known.join(_first_titles(templates, "templates"), "organization_id", "left").join(_first_titles(guidelines, "guidelines"), "organization_id", "left")

    label = first_match([(F.col("period") == p, l) for p, l in PERIOD_LABELS.items()], None)
    about = F.concat(label, F.lit(", "), F.coalesce("category", F.lit("전체 분야")), F.lit(" 기준"))
    n = F.coalesce("n", F.lit(0)).cast("string")
    is_ = lambda name: F.col("name") == name
    answer = (
        F.when(is_("count_articles"), F.concat(about, F.lit(" 회사 기사는 "), n, F.lit("건입니다.")))
        .when(is_("list_recent_articles") & F.col("recent").isNull(), F.concat(about, F.lit(" 회사 기사가 없습니다.")))
        .when(is_("list_recent_articles"), F.concat(about, F.lit(" 최근 회사 기사 "), F.size("recent").cast("string"), F.lit("건입니다.\n"), parsers.numbered_text(F.col("recent"))))
        .when(is_("count_articles_by_category") & F.col("n").isNull(), F.concat(label, F.lit(" 기준 회사 기사가 없습니다.")))
        .when(is_("count_articles_by_category"), F.concat(label, F.lit(" 기준 회사 기사 분야별 개수입니다. (총 "), n, F.lit("건)\n"), F.col("lines")))
        .when(is_("count_articles_by_author"), F.concat(label, F.lit(" 기준 "), F.col("author"), F.lit(" 기자의 회사 기사는 "), n, F.lit("건입니다.")))
        .when(is_("count_articles_by_media"), F.concat(label, F.lit(" 기준 "), F.col("media"), F.lit(" 회사 기사는 "), n, F.lit("건입니다.")))
        .when(is_("list_templates"), _numbered("회사 기사 템플릿 ", F.col("templates"), "개입니다.", "회사에 등록된 기사 템플릿이 없습니다."))
        .when(is_("list_guidelines"), _numbered("회사 작성 지침 ", F.col("guidelines"), "개입니다.", "회사에 등록된 작성 지침이 없습니다."))
        .when(is_("count_members"), F.concat(F.lit("회사 구성원은 "), F.coalesce("members", F.lit(0)).cast("string"), F.lit("명입니다.")))
    )
    return known.select("ask", answer.alias("answer"))


def answered(questions: DataFrame, articles: DataFrame, links: DataFrame, users: DataFrame, templates: DataFrame, guidelines: DataFrame, now: datetime) -> DataFrame:
    """``questions`` (question, article_id, raw model output) with ``answer``; empty where no single organisation holds the article."""
    about = links.join(questions.select("article_id").distinct(), "article_id", "left_semi")
    asked = routed(questions).join(only_organization(about, users), "article_id", "left")
    asked = asked.withColumn("ask", F.when(F.col("organization_id").isNotNull(), F.to_json(F.struct(*KEYS))))
    requests = asked.where(F.col("ask").isNotNull()).select("ask", *KEYS).distinct()
    told = run(requests, articles, links, users, templates, guidelines, now)
    return asked.join(told, "ask", "left").select(*questions.columns, "organization_id", "name", F.coalesce("answer", F.lit("")).alias("answer"))


def answer_source(answer: Column, context: Column) -> Column:
    """struct(source, answer): the current article where its context bears the answer out, else the organisation."""
    usable = F.coalesce(parsers.usable_answer(answer, context), F.lit(False))
    return F.struct(F.when(usable, "current_article").otherwise("organization").alias("source"), F.when(usable, answer).alias("answer"))


def organization_answer(answer: Column, context: Column) -> Column:
    return F.when(F.coalesce(parsers.usable_answer(answer, context), F.lit(False)), answer).otherwise(NOT_FOUND)


def final_context(scope: Column, current: Column, organization: Column, web: Column, company: Column) -> Column:
    """The scope's own context takes the place of the current article's; null for an unknown scope."""
    return F.when(scope == "current_article", current).when(scope == "organization", organization).when(scope == "web", web).when(scope == "company_data", company)


def final_answer(context: Column, answer: Column) -> Column:
    return F.when(strip(F.coalesce(context, F.lit(""))) == "", NOT_FOUND).otherwise(answer)


def evaluation_text(items: Column) -> Column:
    """An evaluation (array of title, verdict, reason) as a message: how many of each verdict, then item by item."""
    *graded, failed = parsers.VERDICTS
    n = lambda v: F.size(F.filter(items, lambda i: i["verdict"] == v))
    count = lambda v: F.concat(F.lit(f"{v} "), n(v).cast("string"), F.lit("개"))
    head = F.concat_ws(", ", *[count(v) for v in graded], F.when(n(failed) > 0, count(failed)))
    item = lambda i: F.concat(F.lit("\n["), i["verdict"], F.lit("] "), i["title"], F.when(F.coalesce(i["reason"], F.lit("")) != "", F.concat(F.lit("\n- 이유: "), i["reason"])).otherwise(""))
    return F.concat_ws("\n", head, F.transform(items, item))


def spoken_text(table: DataFrame, names: tuple[str, ...] = ("body", "text")) -> Column:
    """The text of a row, whichever of ``names`` its table has: of several the first that is not null."""
    held = [n for n in names if dict(table.dtypes).get(n) == "string"]
    if not held:
        raise TypeError(f"a text column is needed: one of {', '.join(names)}")
    return F.coalesce(*held)


def agent(questions: DataFrame, articles: DataFrame, organizations: DataFrame, web: DataFrame, company: DataFrame, answers: DataFrame) -> DataFrame:
    """All questions (question_id, article_id, question, answer: what the model says to the article's own context, raw: its call)
    from context to answer: (question_id, scope, context, answer).

    ``articles`` and ``organizations`` (question_id, context) hold what retrieval found, ``web`` (question_id, context) and
    ``company`` (question_id, answer) what the tools said, ``answers`` (question_id, scope, answer) what the model makes of the
    final context. The scope's context takes the place of the article's; without any there is no answer.
    """
    held = questions.join(articles.select("question_id", F.col("context").alias("own")), "question_id", "left")
    held = held.withColumn("own", F.coalesce("own", F.lit("")))
    call = parsers.checked_call(parsers.tool_call(F.col("raw")), F.col("question"))
    scope = parsers.retrieval_scope(F.col("question"), call, F.col("answer"), F.col("own"))
    held = held.select("question_id", "own", scope.alias("scope"))
    for name, table, column in (("organization", organizations, "context"), ("web", web, "context"), ("company", company, "answer")):
        held = held.join(table.select("question_id", F.col(column).alias(name)), "question_id", "left")
    context = F.coalesce(final_context(F.col("scope"), F.col("own"), F.col("organization"), F.col("web"), F.col("company")), F.lit(""))
    held = held.select("question_id", "scope", context.alias("context")).join(answers.select("question_id", "scope", "answer"), ["question_id", "scope"], "left")
    return held.select("question_id", "scope", "context", final_answer(F.col("context"), F.col("answer")).alias("answer"))


def titles_of(table: DataFrame) -> DataFrame:
    """(organization_id, id, title, nth): the first titles of each organisation, as many as an answer lists."""
    order = Window.partitionBy("organization_id").orderBy("id")
    return table.select("organization_id", "id", "title").withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= TITLES)
