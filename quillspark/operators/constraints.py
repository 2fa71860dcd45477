"""Audit of checks, keys and references: (table, rule, n) for every rule that is broken. Checks pass on null, as in SQL."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .snapshots import Refused, Store
from .storage import saved, temporary

#: The rules of each table.
TRIMMED = {
    "organizations": ("name", "code", "admin_code"), "users": ("nickname", "email", "password_hash"), "articles": ("content_hash", "title", "body", "media", "author", "category"),
    "article_chunks": ("content",), "files": ("title", "mime_type"), "conversations": ("title",), "messages": ("content",), "templates": ("title", "content"), "guidelines": ("title", "content"), "refresh_tokens": ("token_hash",),
}
ONE_OF = {("users", "role"): ("member", "admin"), ("articles", "visibility"): ("private", "public"), ("messages", "role"): ("user", "assistant")}
NOT_NEGATIVE = (("article_chunks", "chunk_index"), ("files", "size_bytes"))
UNIQUE = {
    "organizations": (("code",), ("admin_code",)), "users": (("email",),), "articles": (("organization_id", "content_hash"),), "article_chunks": (("article_id", "chunk_index"),), "files": (("article_id",),),
    "conversations": (("user_id", "article_id"),), "user_articles": (("user_id", "article_id"),), "refresh_tokens": (("token_hash",),),
}
REFERENCES = (
    ("users", "organization_id", "organizations"), ("articles", "organization_id", "organizations"), ("article_chunks", "article_id", "articles"), ("files", "article_id", "articles"), ("conversations", "user_id", "users"), ("conversations", "article_id", "articles"),
    ("messages", "conversation_id", "conversations"), ("user_articles", "user_id", "users"), ("user_articles", "article_id", "articles"), ("templates", "organization_id", "organizations"), ("guidelines", "organization_id", "organizations"), ("refresh_tokens", "user_id", "users"),
)


def checks(name: str, df: DataFrame) -> dict[str, Column]:
    """What breaks a check of a table: rule -> condition; absent columns are skipped."""
    rules = {f"{c} trimmed": (F.col(c) != F.trim(c)) | (F.col(c) == "") for c in TRIMMED.get(name, ()) if c in df.columns}
    rules |= {f"{c} allowed": ~F.col(c).isin(*allowed) for (t, c), allowed in ONE_OF.items() if t == name and c in df.columns}
    return rules | {f"{c} not negative": F.col(c) < 0 for t, c in NOT_NEGATIVE if t == name and c in df.columns}


def unique_keys(name: str, df: DataFrame) -> list[tuple[str, ...]]:
    return [key for key in UNIQUE.get(name, ()) if set(key) <= set(df.columns)]


def references(name: str, df: DataFrame, tables: Collection[str]) -> list[tuple[str, str]]:
    """(column, table that it refers to)."""
    return [(c, other) for t, c, other in REFERENCES if t == name and c in df.columns and other in tables]


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """One scan per table for its checks, one aggregate per key, one anti join per reference; absent columns are skipped."""
    found = []
    for name, df in tables.items():
        rules = checks(name, df)
        if rules:
            counts = df.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
            found.append(counts.select(F.explode(F.create_map(*[x for k in rules for x in (F.lit(k), F.col(f"`{k}`"))])).alias("rule", "n")).select(F.lit(name).alias("table_name"), "rule", "n"))
        for key in unique_keys(name, df):
            # sorted, not held in a table of keys: nearly every key is another one
            again = df.select(*key).dropna().withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(key[0]))).where("nth = 2")
            found.append(again.agg(F.lit(name).alias("table_name"), F.lit(f"{', '.join(key)} unique").alias("rule"), F.count("*").alias("n")))
        for c, other in references(name, df, tables):
            lost = df.where(F.col(c).isNotNull()).join(tables[other].select(F.col("id").alias(c)), c, "left_anti")
            found.append(lost.agg(F.lit(name).alias("table_name"), F.lit(f"{c} refers to {other}").alias("rule"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, found).where("n > 0")


# ---------------------------------------------------------------- on changes alone

#: The references to each table: (table, column), in the order of their counts r0, r1, ...
REFERRING = {other: [(t, c) for t, c, o in REFERENCES if o == other] for _, _, other in REFERENCES}
COUNTS = ["n", *[f"r{i}" for i in range(max(map(len, REFERRING.values())))]]
KEYS = "space string, key string, " + ", ".join(f"{c} long" for c in COUNTS)
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _key(df: DataFrame, columns: Collection[str]) -> Column:
    """The values as one string; what is no whole number has its length before it, so no two keys are told alike."""
    kinds = dict(df.dtypes)
    own = lambda c: F.col(c).cast("string")
    parts = [own(c) if kinds[c] in WHOLE else F.concat(F.length(own(c)).cast("string"), F.lit(":"), own(c)) for c in columns]
    return F.concat(*[x for part in parts for x in (F.lit("|"), part)][1:])


def summed(counts: DataFrame, dealt: Collection[str] = ()) -> DataFrame:
    """A row a key, without those of which nothing is left."""
    held = counts.groupBy(*dealt, "space", "key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return held.where(" OR ".join(f"{c} <> 0" for c in COUNTS))


def key_counts(tables: dict[str, DataFrame], names: Collection[str] | None = None, deleted: dict[str, DataFrame] | None = None) -> DataFrame:
    """(space, key, n, r0, ...): how many rows break each check, how often each unique key and each id stands in its table (n), and how often each
    reference names that id (r0, ...). What an audit needs to know of rows that it does not read again; rows of ``deleted`` count
    against those of ``tables``. A table is scanned for its checks and for all its keys, which are counted as they are and only then
    told as strings; an id has a row from each table that names it."""
    names = tables.keys() if names is None else names
    rows = [(name, df, by) for held, by in ((tables, 1), (deleted or {}, -1)) for name, df in held.items()]
    spark, out = rows[0][1].sparkSession, []
    for name, df, by in rows:
        rules = checks(name, df)
        if rules:
            counts = df.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
            wrong = counts.select(F.explode(F.create_map(*[x for k in rules for x in (F.lit(f"check|{name}|{k}"), F.col(f"`{k}`"))])).alias("space", "c"))
            out.append(_told(wrong.select("space", F.lit("").alias("key"), F.lit("n").alias("of"), F.col("c") * by)))
        uses = {key: [(f"unique|{name}|{', '.join(key)}", "n")] for key in unique_keys(name, df)}
        for c, other in references(name, df, names):
            uses.setdefault((c,), []).append((f"id|{other}", f"r{REFERRING[other].index((name, c))}"))
        if name in REFERRING and "id" in df.columns:
            uses.setdefault(("id",), []).append((f"id|{name}", "n"))
        if uses:
            columns = sorted({c for key in uses for c in key})
            counts = df.groupingSets([[F.col(c) for c in key] for key in uses], *columns).agg(F.grouping_id(*columns).alias("_set"), (F.count("*") * by).alias("c"))
            told = F.lit(None)
            for key, of in uses.items():
                absent = int("".join("01"[c not in key] for c in columns), 2)  # a bit a column, as grouping_id has them
                own = reduce(Column.__and__, [F.col(c).isNotNull() for c in key], F.col("_set") == absent)
                said = F.col(key[0]).cast("string") if of[0][0].startswith("id|") else _key(df, key)
                told = F.when(own, F.array(*[F.struct(F.lit(space).alias("space"), said.alias("key"), F.lit(count).alias("of")) for space, count in of])).otherwise(told)
            out.append(_told(counts.select(F.explode(told).alias("x"), "c").select("x.*", "c")))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], KEYS)


def _told(rows: DataFrame) -> DataFrame:
    """(space, key, of, c) with a column a count."""
    space, key, of, c = (F.col(f"`{x}`") for x in rows.columns)
    return rows.select(space, key, *[F.when(of == x, c).otherwise(0).alias(x) for x in COUNTS])


def broken(counts: DataFrame) -> dict[tuple[str, str], int]:
    """(table, rule) -> how often it is broken, as far as ``counts`` tell: one scan without a join, as an id and its references are one row."""
    lost = [F.sum(F.when(F.col("n") == 0, F.col(c))).alias(c) for c in COUNTS[1:]]
    out = {}
    for r in counts.groupBy("space").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("again"), F.min(F.least(*COUNTS)).alias("least"), *lost).collect():  # a row a rule or table
        if r["least"] < 0:
            raise Refused("rows are deleted that the tables do not hold")
        kind, name, *rule = r["space"].split("|", 2)
        if kind == "check":
            out[name, rule[0]] = r["n"]
        elif kind == "unique":
            out[name, f"{rule[0]} unique"] = r["again"]
        else:
            out |= {(t, f"{c} refers to {name}"): r[f"r{i}"] or 0 for i, (t, c) in enumerate(REFERRING[name])}
    return out


NOTE = "audit"


def _noted(tables: Collection[str], total: dict[tuple[str, str], int]) -> dict:
    return {"tables": sorted(tables), "broken": [[t, rule, n] for (t, rule), n in sorted(total.items()) if n]}


def begin_audit(store: Store, tables: dict[str, DataFrame]) -> DataFrame:
    """Audit whole tables and keep what the audits of later changes need."""
    with temporary(store.spark), store.change() as change:
        change.merge("keys", saved(key_counts(tables), "key-counts"), "key", summed)
        change.note(NOTE, _noted(tables, broken(store.read("keys", change.new))))
    return audited(store)


def audit_change(store: Store, inserted: dict[str, DataFrame], deleted: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, n) after a change, from its rows (an update deletes one row and inserts another) and the kept counts of their keys.

    Only buckets that hold a key of the change are read and rewritten, once; what is broken in them before and after is counted where
    they lie. The kept counts and numbers switch together, or not at all. A change that deletes rows which were never there is refused.
    """
    base = store.latest()
    names = base.notes[NOTE]["tables"]
    if not inserted and not deleted:
        return audited(store)
    with temporary(store.spark), store.change(base) as change:
        moved = saved(key_counts(inserted, names, deleted), "moved-keys")
        buckets = change.merge("keys", moved, "key", summed)
        total = {(t, rule): n for t, rule, n in base.notes[NOTE]["broken"]}
        for version, sign in ((base, -1), (change.new, 1)):
            for rule, n in broken(store.read("keys", version, buckets)).items():
                total[rule] = total.get(rule, 0) + sign * n
        change.note(NOTE, _noted(names, total))
    return audited(store)


def audited(store: Store) -> DataFrame:
    return store.spark.createDataFrame([tuple(x) for x in store.latest().notes[NOTE]["broken"]], "table_name string, rule string, n long")
