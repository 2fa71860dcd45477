"""Archive questions: scopes, counts, lists and access. A scope is a semi join, so no body is ever made distinct."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.parsers import VERDICTS
from quillspark.functions.periods import PERIOD_LABELS, UNCATEGORIZED, within


def articles_of_user(articles: DataFrame, links: DataFrame, user_id: int) -> DataFrame:
    return articles.join(links.where(F.col("user_id") == user_id).select(F.col("article_id").alias("id")), "id", "left_semi")


def holders(links: DataFrame, users: DataFrame) -> DataFrame:
    """(organization_id, article_id) once each: which organisation has members that hold which article."""
    return links.join(users.select(F.col("id").alias("user_id"), "organization_id"), "user_id").select("organization_id", "article_id").distinct()


def articles_of_organization(articles: DataFrame, links: DataFrame, users: DataFrame, organization_id: int, visibility: str | None = None) -> DataFrame:
    members = users.where(F.col("organization_id") == organization_id).select(F.col("id").alias("user_id"))
    held = links.join(members, "user_id", "left_semi").select(F.col("article_id").alias("id"))
    own = articles if visibility is None else articles.where(F.col("visibility") == visibility)
    return own.join(held, "id", "left_semi")


def article_date(articles: DataFrame) -> Column:
    """The date that periods go by: published, else created where the table has that column."""
    return F.coalesce("published_at", "created_at") if "created_at" in articles.columns else F.col("published_at")


def scoped(articles: DataFrame, links: DataFrame, users: DataFrame, period: str, now: datetime, category: str | None = None) -> DataFrame:
    """Articles of every organisation (one row per organisation and article) within a period and category."""
    own = articles.where(within(article_date(articles), period, now))
    own = own if category is None else own.where(F.col("category") == category)
    return own.join(holders(links, users), own["id"] == F.col("article_id")).drop("article_id")


def count_articles(scope: DataFrame) -> DataFrame:
    return scope.groupBy("organization_id").agg(F.count("*").alias("n"))


def count_by_category(scope: DataFrame) -> DataFrame:
    """Nulls get their label after grouping, so a category of that very name stays apart."""
    return scope.groupBy("organization_id", "category").agg(F.count("*").alias("n")).withColumn("category", F.coalesce("category", F.lit(UNCATEGORIZED)))


def recent(scope: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("organization_id").orderBy(F.desc("published_at"), F.desc("id"))
    return scope.select("organization_id", "id", "title", article_date(scope).alias("published_at")).withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= n)


def search_organization(articles: DataFrame, links: DataFrame, users: DataFrame) -> DataFrame:
    """(article_id, organization_id, error): the one organisation that a search around the article covers; ``none`` or
    ``several`` as error where there is no such one."""
    held = links.join(users.select(F.col("id").alias("user_id"), "organization_id"), "user_id").groupBy("article_id").agg(F.min("organization_id").alias("lo"), F.max("organization_id").alias("hi"))
    found = articles.select(F.col("id").alias("article_id")).join(held, "article_id", "left")
    return found.select("article_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("organization_id"), F.when(F.col("lo").isNull(), "none").when(F.col("lo") != F.col("hi"), "several").alias("error"))


def only_organization(links: DataFrame, users: DataFrame) -> DataFrame:
    """The organisation of each article, null if several hold it."""
    held = links.join(users.select(F.col("id").alias("user_id"), "organization_id"), "user_id").groupBy("article_id").agg(F.min("organization_id").alias("lo"), F.max("organization_id").alias("hi"))
    return held.select("article_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("organization_id"))


def access(users: DataFrame, links: DataFrame, articles: DataFrame, article_id: int) -> DataFrame:
    """Whether each user may read one article: it is public, or the user is an admin of its organisation, or holds it."""
    public = articles.where((F.col("id") == article_id) & (F.col("visibility") == "public")).select(F.lit(1).alias("public"))
    held = links.where(F.col("article_id") == article_id).select("user_id").distinct().withColumn("holds", F.lit(True))
    orgs = users.join(held, users["id"] == held["user_id"], "left_semi").select(F.col("organization_id").alias("org")).distinct().withColumn("in_org", F.lit(True))
    out = users.join(held, users["id"] == held["user_id"], "left").join(orgs, users["organization_id"] == orgs["org"], "left")
    flag = public.agg((F.count("*") > 0).alias("is_public"))
    return out.join(F.broadcast(flag)).select(F.col("id").alias("user_id"), (F.col("is_public") | F.coalesce("holds", F.lit(False)) | ((F.col("role") == "admin") & F.coalesce("in_org", F.lit(False)))).alias("may_read"))


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation, oldest first."""
    if n < 1:
        raise ValueError("n must be at least 1")
    order = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    return messages.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def question_pairs(messages: DataFrame) -> DataFrame:
    """(question, answer): an answer belongs to the user message just before it (system messages aside)."""
    own = messages.where("role <> 'system'")
    order = Window.partitionBy("conversation_id").orderBy("id")
    near = own.withColumns({"was": F.lag("role").over(order), "said": F.lag("content").over(order), "next": F.lead("role").over(order)})
    answered = near.where("role = 'assistant'").select("conversation_id", "id", F.when(F.col("was") == "user", F.col("said")).otherwise("").alias("question"), F.col("content").alias("answer"))
    open_ = near.where("role = 'user' AND (next IS NULL OR next <> 'assistant')").select("conversation_id", "id", F.col("content").alias("question"), F.lit("").alias("answer"))
    return answered.unionByName(open_)


def nested(messages: DataFrame) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("id", "role", "content")))
    return messages.groupBy("conversation_id").agg(held.alias("messages"), F.count("*").alias("total"))


def merge_history(current: DataFrame, loaded: DataFrame, key: str = "id") -> DataFrame:
    """Full outer join by key; the current row wins."""
    c, l = current.alias("c"), loaded.alias("l")
    joined = c.join(l, F.col(f"c.{key}") == F.col(f"l.{key}"), "full_outer")
    return joined.select(*[F.when(F.col(f"c.{key}").isNotNull(), F.col(f"c.{x}")).otherwise(F.col(f"l.{x}")).alias(x) for x in current.columns])


def sentence_count(counts: DataFrame, period: str, category: str | None) -> DataFrame:
    head = f"{PERIOD_LABELS[period]}, {category or '전체 분야'} 기준 회사 기사는 "
    return counts.select("organization_id", F.concat(F.lit(head), F.col("n").cast("string"), F.lit("건입니다.")).alias("answer"))


def sentence_recent(rows: DataFrame, period: str, category: str | None) -> DataFrame:
    label = f"{PERIOD_LABELS[period]}, {category or '전체 분야'} 기준"
    line = F.concat(F.col("nth").cast("string"), F.lit(". "), F.col("title"), F.lit(" ("), F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("날짜 없음")), F.lit(")"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("l")))), lambda x: x["l"])
    return rows.groupBy("organization_id").agg(F.concat(F.lit(f"{label} 최근 회사 기사 "), F.count("*").cast("string"), F.lit("건입니다.\n"), F.array_join(held, "\n")).alias("answer"))


def sentence_categories(counts: DataFrame, period: str) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category")))
    held = F.transform(order, lambda x: F.concat(F.lit("- "), x["category"], F.lit(": "), (-x["n"]).cast("string"), F.lit("건")))
    return counts.groupBy("organization_id").agg(F.concat(F.lit(f"{PERIOD_LABELS[period]} 기준 회사 기사 분야별 개수입니다. (총 "), F.sum("n").cast("string"), F.lit("건)\n"), F.array_join(held, "\n")).alias("answer"))


def count_members(users: DataFrame) -> DataFrame:
    return users.groupBy("organization_id").agg(F.count("*").alias("n"))


def user_responses(users: DataFrame, organizations: DataFrame) -> DataFrame:
    """Users as they are shown: with their organisation's name, without what is secret."""
    return users.join(organizations.select(F.col("id").alias("organization_id"), F.col("name").alias("organization")), "organization_id").select("organization", "nickname", "role")


def verdict_tally(verdicts: DataFrame, verdict: Column) -> DataFrame:
    """One row: how many of each verdict (met, short, none, failed)."""
    return verdicts.agg(*[F.count_if(verdict == x).alias(n) for n, x in zip(("met", "short", "none", "failed"), VERDICTS, strict=True)])
