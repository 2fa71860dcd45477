"""Secret scan with multipart credential linking, with DataFrame functions only.

Strong findings (an assignment, an access identifier, a long hex run) are always reported. Weak candidates - endpoints,
account names, bare 40-character tokens - are reported only when a part that completes them stands within ``scope``
code points. The link is an interval join: parts fall into cells of ``scope`` code points, each cell is first reduced to
the first and last start of each role, and a candidate meets the three cells around it, so the join never makes pairs of
parts. Regular expressions give texts, not places; places come from the lengths of what stands between the matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import match_spans, saved

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ACCOUNT = r"""(?i)(?:client|account|tenant|user|access)_?(?:id|name|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""
ENDPOINT = r"""https?://[^\s"'<>]+"""

#: kind, role, cheap test, pattern; in the order in which kinds rank at one start.
STRONG = (
    ("assign", "secret", r"(?i)password|passwd|secret|token|api_?key", ASSIGN),
    ("access", "identifier", r"AKIA[A-Z0-9]", ACCESS),
    ("hex", "secret", r"[0-9a-f]{32}", HEX),
)
WEAK = (
    ("token40", "candidate", r"[A-Za-z0-9+/]{40}", TOKEN),
    ("account", "account", r"(?i)(?:id|name)[\"']?\x20*[:=]", ACCOUNT),
    ("endpoint", "endpoint", r"https?://", ENDPOINT),
)
#: What completes a weak candidate of a role.
COMPLETES = {"candidate": ("identifier", "account"), "account": ("secret", "candidate"), "endpoint": ("secret", "identifier")}
SPAN = "array<struct<s:int,k:int,e:int>>"


def _found(text: Column, kind: int, test: str, pattern: str, keep=None) -> Column:
    """Spans (start, kind, end) of the matches, in code points; ``keep`` tests the matched text."""
    held = match_spans(text, pattern)
    held = held if keep is None else F.filter(held, lambda x: keep(x["hit"]))
    spans = F.transform(held, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))
    return F.when(text.rlike(test), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _long_value(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, two keys of the row, base spans and weak candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keeps = (_long_value, lambda hit: F.length(hit) >= 16, None)
    base = F.concat(*[_found(text, i, test, pattern, keep) for i, ((_, _, test, pattern), keep) in enumerate(zip(STRONG, keeps, strict=True))])
    weak = F.concat(*[_found(text, len(STRONG) + i, test, pattern) for i, (_, _, test, pattern) in enumerate(WEAK)])
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(text, F.lit(7), F.col(id_col)).alias("k2"), base.alias("base"), weak.alias("weak"))


def link(parts: DataFrame, scope: int) -> DataFrame:
    """(k1, k2, linked): the weak candidates of each text that have a completing part within ``scope`` code points."""
    roles = [r for _, r, _, _ in (*STRONG, *WEAK)]
    role = F.element_at(F.lit(roles), F.col("x.k") + 1)
    own = parts.where(F.size("weak") > 0).select("k1", "k2", "base", "weak").dropDuplicates(["k1", "k2"])
    every = own.select("k1", "k2", F.explode(F.concat("base", "weak")).alias("x"))
    # weak candidates that touch a base span go: along the text, the largest end before and the smallest start after tell
    firm, here = F.col("x.k") < len(STRONG), Window.partitionBy("k1", "k2")
    before = F.max(F.when(firm, F.col("x.e"))).over(here.orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(firm, F.col("x.s"))).over(here.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumns({"before": before, "after": after}).where(firm | (F.coalesce(F.col("before") <= F.col("x.s"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("x.e"), F.lit(True))))
    every = saved(every.select("k1", "k2", "x", role.alias("role"), F.col("x.s").alias("s"), F.floor(F.col("x.s") / scope).cast("long").alias("cell")), "secret-places")
    cells = every.where("role <> 'endpoint'").groupBy("k1", "k2", "cell", "role").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    seek = every.where(~firm).select("k1", "k2", "x", F.col("role").alias("own"), F.col("cell").alias("c"))
    seek = seek.withColumn("cell", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    fits = reduce(lambda a, b: a | b, [(F.col("own") == o) & F.col("role").isin(*rs) for o, rs in COMPLETES.items()])
    near = (F.col("cell") == F.col("c")) | ((F.col("cell") < F.col("c")) & (F.col("x.s") - F.col("hi") <= scope)) | ((F.col("cell") > F.col("c")) & (F.col("lo") - F.col("x.s") <= scope))
    return seek.join(cells, ["k1", "k2", "cell"]).where(fits & near).groupBy("k1", "k2").agg(F.collect_set("x").alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per input row: id, base (spans), linked (weak spans with a completing part), as arrays of (s, k, e).

    Kinds are numbered along STRONG then WEAK. Offsets are code points, the end exclusive.
    Defined cases: null and empty texts have no spans; null ids are kept; repeated rows each get their spans; an empty
    table gives no rows; other columns of the input are not read.
    """
    parts = saved(find_parts(docs, id_col, text_col), "secret-parts")
    out = parts.join(link(parts, scope), ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.array_sort("base").alias("base"), F.array_sort(F.coalesce("linked", F.array().cast(SPAN))).alias("linked"))


def as_text(spans: Column) -> Column:
    names = F.lit([k for k, _, _, _ in (*STRONG, *WEAK)])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
