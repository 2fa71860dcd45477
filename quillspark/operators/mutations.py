"""Changes as functions from tables to tables: a snapshot goes in, the next one comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import numbered


def appended(table: DataFrame, new: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """New rows get dense ids after the largest one."""
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    fresh = numbered(new.drop(id_col), [order] if order else [c for c in new.columns if c != id_col], id_col, int(top) + 1)
    return table.unionByName(fresh, allowMissingColumns=True)


def linked(links: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent: links that exist stay as they are."""
    fresh = new.select(*links.columns).distinct()
    return links.unionByName(fresh.join(links, links.columns, "left_anti"))


def conversation_for(conversations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Get or create: one conversation per (user, article); wanted has user_id, article_id, title."""
    first = wanted.groupBy("user_id", "article_id").agg(F.min("title").alias("title"))
    return appended(conversations, first.join(conversations, ["user_id", "article_id"], "left_anti"))


def upsert_by_hash(articles: DataFrame, uploads: DataFrame, order: str) -> DataFrame:
    """Uploads whose (organization_id, content_hash) is new, the first of each in the batch."""
    key = ["organization_id", "content_hash"]
    first = uploads.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_nth = 1").drop("_nth")
    return first.join(articles.select(*key), key, "left_anti")


def replaced_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the articles in ``new`` are replaced; a repeated or negative index refuses the whole change."""
    bad = new.where("chunk_index < 0 OR chunk_index IS NULL").limit(1).unionByName(new.groupBy("article_id", "chunk_index").agg(F.count("*").alias("n")).where("n > 1").join(new, ["article_id", "chunk_index"]).select(*new.columns).limit(1))
    if bad.head(1):
        return chunks
    return chunks.join(new.select("article_id").distinct(), "article_id", "left_anti").select(*chunks.columns).unionByName(new.select(*chunks.columns))


def updated(table: DataFrame, changes: DataFrame, key: str, columns: list[str], now: Column) -> DataFrame:
    """Only what is given changes; updated_at moves only where a row is touched."""
    c = changes.select(F.col(key), *[F.col(x).alias(f"_new_{x}") for x in columns], F.lit(True).alias("_hit"))
    out = table.join(c, key, "left")
    out = out.withColumns({x: F.coalesce(f"_new_{x}", x) for x in columns})
    if "updated_at" in table.columns:
        out = out.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
    return out.select(*table.columns)


def without(table: DataFrame, keys: DataFrame, on: dict[str, str]) -> DataFrame:
    """``table`` less the rows whose columns match a key: on = {column of table: column of keys}."""
    k = keys.select(*[F.col(b).alias(f"_k_{a}") for a, b in on.items()]).distinct()
    cond = [table[a] == k[f"_k_{a}"] for a in on]
    return table.join(k, cond, "left_anti")


def orphaned(messages: DataFrame, gone: DataFrame, kept: DataFrame) -> DataFrame:
    """``messages`` less those of the conversations ``gone``. An id may stand for several conversations (ids made from other keys
    can meet): its messages stay while one of them is ``kept``."""
    ids = gone.select("id").distinct()
    return without(messages, ids.join(kept.select("id"), "id", "left_anti"), {"conversation_id": "id"})


def delete_articles(t: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """ids (id): the articles with their chunks, files, links, conversations and messages."""
    talks = t["conversations"].join(ids.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    out = dict(t)
    for name in ("conversations", "user_articles", "article_chunks", "files"):
        if name in t:
            out[name] = without(t[name], ids, {"article_id": "id"})
    out["messages"] = orphaned(t["messages"], talks, out["conversations"])
    out["articles"] = without(t["articles"], ids, {"id": "id"})
    return out


def delete_link(t: dict[str, DataFrame], user_id: int, article_id: int) -> dict[str, DataFrame]:
    own = (F.col("user_id") == user_id) & (F.col("article_id") == article_id)
    out = dict(t)
    out["messages"] = without(t["messages"], t["conversations"].where(own), {"conversation_id": "id"})
    out["conversations"] = t["conversations"].where(~own)
    out["user_articles"] = t["user_articles"].where(~own)
    return out


def delete_member(t: dict[str, DataFrame], user_id: int) -> dict[str, DataFrame]:
    """The user with own conversations, links and tokens; own private articles with all that hangs on them."""
    held = t["user_articles"].where(F.col("user_id") == user_id)
    private = t["articles"].where("visibility = 'private'").join(held.select(F.col("article_id").alias("id")), "id", "left_semi").select("id")
    out = delete_articles(t, private)
    own = t["conversations"].where(F.col("user_id") == user_id)
    for name in ("conversations", "user_articles", "refresh_tokens"):
        if name in t:
            out[name] = out[name].where(F.col("user_id") != user_id)
    out["messages"] = orphaned(out["messages"], own, out["conversations"])
    out["users"] = t["users"].where(F.col("id") != user_id)
    return out


def delete_article_for(t: dict[str, DataFrame], user_id: int, article_id: int) -> dict[str, DataFrame]:
    """A private article goes altogether; of a public one only the user's link."""
    row = t["articles"].where(F.col("id") == article_id).select("visibility").head()
    if row and row[0] == "private":
        return delete_articles(t, t["articles"].where(F.col("id") == article_id).select("id"))
    return delete_link(t, user_id, article_id)


def unexpired(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.where(F.col("expired_at") > now)


def removed_rows(table: DataFrame, keys: DataFrame, on: dict[str, str]) -> DataFrame:
    """One row: how many rows ``without`` takes away (n)."""
    k = keys.select(*[F.col(b).alias(f"_k_{a}") for a, b in on.items()]).distinct()
    return table.join(k, [table[a] == k[f"_k_{a}"] for a in on], "left_semi").agg(F.count("*").alias("n"))
