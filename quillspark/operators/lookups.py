"""Point and tenant lookups, and the rules of an administrator's changes as (status, detail) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip

OK, BAD, MISSING, CLASH = 200, 400, 404, 409


def by_key(table: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns equal the values; the filter reaches the scan. A null value matches nothing."""
    out = table
    for name, value in values.items():
        out = out.where(F.col(name) == F.lit(value))
    return out


def one_by_key(table: DataFrame, id_col: str = "id", **values: object) -> DataFrame:
    """At most one row: of several the one with the smallest id."""
    return by_key(table, **values).orderBy(id_col).limit(1)


def by_token(tokens: DataFrame, token: str) -> DataFrame:
    """A token is kept as its SHA-256 only."""
    return tokens.where(F.col("token_hash") == F.sha2(F.lit(token).cast("binary"), 256))


def organization_of(users: DataFrame, organizations: DataFrame, user_id: int) -> DataFrame:
    return organizations.join(users.where(F.col("id") == user_id).select(F.col("organization_id").alias("id")), "id", "left_semi")


def owned_conversations(conversations: DataFrame, user_id: int) -> DataFrame:
    """A foreign conversation is as absent as a missing one."""
    return by_key(conversations, user_id=user_id)


def _result(*failures: tuple[Column, int, str]) -> Column:
    """The first failure that holds, else OK; a test that is null does not hold."""
    out = F.lit(None)
    for test, status, detail in reversed(failures):
        out = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit(detail).alias("detail"))).otherwise(out)
    return F.coalesce(out, F.struct(F.lit(OK).alias("status"), F.lit("").alias("detail")))


def article_update(found: Column, title: Column, visibility: Column) -> Column:
    """Whether an article's title or visibility may change to what is given (null: not given)."""
    return _result(
        (~found, MISSING, "no such article"),
        (title.isNull() & visibility.isNull(), BAD, "nothing to change"),
        (strip(title) == "", BAD, "blank title"),
        (~visibility.isin("private", "public"), BAD, "unknown visibility"),
    )


def member_update(found: Column, member_id: Column, admin_id: Column, admin_role: Column, role: Column) -> Column:
    """Whether a member's role may become ``role`` (null: not given); nobody changes their own."""
    return _result(
        (~role.isin("member", "admin"), BAD, "unknown role"),
        (~found, MISSING, "no such member"),
        ((member_id == admin_id) & (role != admin_role), BAD, "own role"),
    )


def member_delete(found: Column, member_id: Column, admin_id: Column) -> Column:
    return _result((member_id == admin_id, BAD, "own account"), (~found, MISSING, "no such member"))


def article_of_conversation(articles: DataFrame, conversations: DataFrame, conversation_id: int) -> DataFrame:
    own = conversations.where(F.col("id") == conversation_id).select(F.col("article_id").alias("id"))
    return articles.join(own, "id", "left_semi")


def conversation_of_article(conversations: DataFrame, article_id: int) -> DataFrame:
    """Of several the one with the smallest id."""
    return one_by_key(conversations, article_id=article_id)


def holder_of(users: DataFrame, links: DataFrame, article_id: int) -> DataFrame:
    """A user that holds the article: of several the one with the smallest id."""
    held = links.where(F.col("article_id") == article_id).select(F.col("user_id").alias("id"))
    return one_by_key(users.join(held, "id", "left_semi"))


def owned_messages(messages: DataFrame, conversations: DataFrame, user_id: int) -> DataFrame:
    """The messages of a user's own conversations; those of others are as absent as missing ones."""
    own = by_key(conversations, user_id=user_id).select(F.col("id").alias("conversation_id"))
    return messages.join(own, "conversation_id", "left_semi")


def article_responses(articles: DataFrame, columns: tuple[str, ...] = ("id", "title", "category", "visibility", "published_at")) -> DataFrame:
    """One row: the articles as a list in order of id, and how many there are."""
    held = F.array_sort(F.collect_list(F.struct(*columns)))
    return articles.select(*columns).agg(held.alias("articles"), F.count("*").alias("total"))


def code_rotation(organizations: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, code, status): whether each wanted (id, code) may become the organisation's code: not if another organisation has it
    or a smaller id wants it as well (409), nor for an organisation that does not exist (404)."""
    taken = organizations.select("code", F.col("id").alias("owner"))
    first = wanted.groupBy("code").agg(F.min("id").alias("first"))
    known = organizations.select("id", F.lit(True).alias("known"))
    held = wanted.join(taken, "code", "left").join(first, "code").join(known, "id", "left")
    clash = (F.col("owner").isNotNull() & (F.col("owner") != F.col("id"))) | (F.col("first") != F.col("id"))
    return held.select("id", "code", F.when(F.col("known").isNull(), MISSING).when(clash, CLASH).otherwise(OK).alias("status"))
