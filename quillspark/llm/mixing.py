"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (their *pattern*); only this table, one row per pattern,
goes to the driver. Each pattern offers its tokens ``max_repeats`` times, at a cost that rises with every repetition
(0, 1, 2, ...: convex), to the sources it belongs to; each source asks for its quota. The cheapest flow says how often
each pattern is taken: some whole passes, and a part of one more. That part is the head of a seeded order of the
pattern's documents, found through a histogram of the order's first digits, so no task ever sorts a whole source.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 4
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_repeats")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: int) -> list[float]:
    """Each source's share by weight of all sizes, stopping at ``max_repeats`` times its own; the excess is shared anew."""
    if not sum(sizes):
        return [0.0] * len(sizes)
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        level = (sum(sizes) - sum(max_repeats * sizes[i] for i in capped)) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > max_repeats * sizes[i]}
        if not over:
            return [float(max_repeats * s) if i in capped else level * weights[i] for i, s in enumerate(sizes)]
        capped |= over


def min_cost_flow(supply: Sequence[float], members: Sequence[Sequence[int]], quota: Sequence[float], max_repeats: int) -> list[dict[int, float]]:
    """Flow of tokens from patterns to sources: successive cheapest augmenting paths with potentials.

    Nodes: 0 origin, patterns, sources, goal. The arcs origin->pattern are ``max_repeats`` parallel ones of cost 0, 1, 2...
    """
    p, s = len(supply), len(quota)
    goal, arcs, out = p + s + 1, [], [[] for _ in range(p + s + 2)]

    def arc(a: int, b: int, cap: float, cost: float) -> None:
        out[a].append(len(arcs))
        arcs.append([b, cap, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0.0, -cost])

    for i, x in enumerate(supply):
        for r in range(max_repeats):
            arc(0, 1 + i, float(x), float(r))
    lanes = {}
    for i, sources in enumerate(members):
        for j in sources:
            lanes[i, j] = len(arcs)
            arc(1 + i, 1 + p + j, math.inf, 0.0)
    for j, x in enumerate(quota):
        arc(1 + p + j, goal, float(x), 0.0)
    potential = [0.0] * (goal + 1)
    while True:
        dist, via, heap = [math.inf] * (goal + 1), [-1] * (goal + 1), [(0.0, 0)]
        dist[0] = 0.0
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k in out[a]:
                b, cap, cost = arcs[k]
                if cap > 1e-6 and (e := d + cost + potential[a] - potential[b]) < dist[b] - 1e-12:
                    dist[b], via[b] = e, k
                    heapq.heappush(heap, (e, b))
        if dist[goal] == math.inf:
            return [{j: f for j in m if (f := arcs[lanes[i, j] ^ 1][1]) > 1e-6} for i, m in enumerate(members)]
        potential = [x + (d if d < math.inf else 0.0) for x, d in zip(potential, dist, strict=True)]
        b, push = goal, math.inf
        while b:
            push, b = min(push, arcs[via[b]][1]), arcs[via[b] ^ 1][0]
        b = goal
        while b:
            k = via[b]
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
            b = arcs[k ^ 1][0]


def cheapest(supply: Sequence[float], members: Sequence[Sequence[int]], quota: Sequence[float], max_repeats: int) -> list[dict[int, float]]:
    """``min_cost_flow``, solved apart for each group of sources that share patterns."""
    root = list(range(len(quota)))

    def find(j: int) -> int:
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        return j

    for m in members:
        for j in m[1:]:
            root[find(j)] = find(m[0])
    parts: dict[int, list[int]] = {}
    for i, m in enumerate(members):
        if m:
            parts.setdefault(find(m[0]), []).append(i)
    out: list[dict[int, float]] = [{} for _ in members]
    for own in parts.values():
        sources = sorted({j for i in own for j in members[i]})
        place = {j: k for k, j in enumerate(sources)}
        flows = min_cost_flow([supply[i] for i in own], [[place[j] for j in members[i]] for i in own], [quota[j] for j in sources], max_repeats)
        for i, f in zip(own, flows, strict=True):
            out[i] = {sources[k]: x for k, x in f.items()}
    return out


def _by_code_point(names: Sequence[str | None]) -> list[str | None]:
    return sorted(names, key=lambda x: (x is None, x or ""))


def cycle_weights(names: Sequence[str | None], cycle: Sequence[float] = (1, 2, 3)) -> list[float]:
    return [cycle[i % len(cycle)] for i in range(len(names))]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, weights: Callable[[Sequence[str | None]], Sequence[float]] = cycle_weights, max_repeats: int = 3, seed: str = "mix", broadcast_rows: int = 100_000) -> DataFrame:
    """The input's columns and mix_size, mix_source_size, mix_target, mix_repeats (0 to ``max_repeats``).

    ``sources`` is an array column with the sources of a row (default: its ``source`` alone); ``weights`` maps the sorted
    source names (code points, null last) to weights. A row of several sources has the sum of their sizes and targets.
    Defined cases: a null or empty text has size 0; null is a source like others; an empty or null source list takes no
    part (0 repeats); rows that repeat the same id and text are decided alike; an empty table gives no rows. Existing
    columns of the four names are replaced; all others, whatever their names, are kept.
    """
    spark = docs.sparkSession
    held = F.array_sort(F.array_distinct(sources)) if sources is not None else F.array(F.col("source"))
    pattern = F.coalesce(F.to_json(F.struct(held.alias("s")), {"ignoreNullFields": "false"}), F.lit("{}"))
    key = F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select(pattern.alias("p"), held.alias("held"), words_in(F.col(text_col)).alias("size"), F.conv(F.left(key, F.lit(DIGITS)), 16, 10).cast("int").alias("bucket"))
    histogram = rows.groupBy("p", "bucket").agg(F.sum("size").alias("size"), F.first("held").alias("held"))
    histogram = saved(histogram, "mix-histogram")
    patterns = histogram.groupBy("p").agg(F.sum("size").alias("size"), F.first("held").alias("held")).orderBy("p").collect()
    names = _by_code_point(list({x for r in patterns for x in (r["held"] or [])}))
    place = {x: i for i, x in enumerate(names)}
    member = [[place[x] for x in (r["held"] or [])] for r in patterns]
    own = [0] * len(names)
    for r, m in zip(patterns, member, strict=True):
        for j in m:
            own[j] += r["size"]
    single = all(len(m) <= 1 for m in member)
    quota = targets(own, weights(names), max_repeats)
    flows = cheapest([r["size"] for r in patterns], member, quota, max_repeats)
    plan = []
    for r, m, f in zip(patterns, member, flows, strict=True):
        taken = sum(f.values())
        if single and m and abs(taken - quota[m[0]]) < 1e-3:
            taken = quota[m[0]]  # without the rounding of the flow's sums
        passes = int(taken // r["size"]) if r["size"] else 0
        plan.append((r["p"], sum(own[j] for j in m), float(sum(quota[j] for j in m)), passes, float(taken - passes * r["size"])))
    plan_df = spark.createDataFrame(plan, "p string, mix_source_size long, mix_target double, passes int, rest double")
    few = len(plan) <= broadcast_rows
    near = F.broadcast if few else (lambda x: x)

    upto = Window.partitionBy("p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = histogram.withColumn("upto", F.sum("size").over(upto)).join(near(plan_df), "p").where("upto > rest").groupBy("p").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "rest"), "bucket").alias("e")).select("p", "e.*")
    inside = docs.select(pattern.alias("p"), words_in(F.col(text_col)).alias("size"), key.alias("key")).withColumn("bucket", F.conv(F.left("key", F.lit(DIGITS)), 16, 10).cast("int"))
    inside = inside.join(near(edge), ["p", "bucket"]).groupBy("p", "bucket", "before", "rest", "key").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("p").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("mid", F.col("before") + F.sum("size").over(order) - F.col("size") / 2)
    head = inside.groupBy("p").agg(F.max(F.when(F.col("mid") <= F.col("rest"), F.col("key"))).alias("last"), F.lpad(F.lower(F.hex(F.min("bucket"))), DIGITS, "0").alias("edge")).select("p", F.coalesce("last", "edge").alias("last"))
    last = {r["p"]: r["last"] for r in head.collect()}
    # no edge: the rest takes every document of the pattern ("g" is above all keys)
    plan_df = spark.createDataFrame([(*x[:4], last.get(x[0], "g")) for x in plan], "p string, source_size long, target double, passes int, last string")
    kept = [c for c in docs.columns if c not in ADDED]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), words_in(F.col(text_col)).alias("size"), key.alias("key"), pattern.alias("p")).join(near(plan_df), "p", "left")
    repeats = F.when(F.col("source_size").isNull() | (F.col("source_size") == 0), 0).otherwise(F.least(F.lit(max_repeats), F.col("passes") + (F.col("key") <= F.col("last")).cast("int")))
    return out.select("doc.*", *(c.alias(x) for x, c in zip(ADDED, (F.col("size"), F.col("source_size"), F.col("target"), repeats.cast("int")), strict=True)))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), 'null') || chr(31) || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS own, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER o AS place, CAST(sum(own) OVER () - 3 * coalesce(sum(own) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s WINDOW o AS (ORDER BY own / w, encode(source) NULLS LAST)),
l AS (SELECT arg_min(level, place) FILTER (WHERE level * w <= 3 * own) AS level FROM r),
t AS (SELECT s.*, CASE WHEN level * w > 3 * own THEN CAST(3 * own AS DOUBLE) ELSE level * w END AS target FROM s, l),
q AS (SELECT *, CASE WHEN own > 0 THEN CAST(floor(target / own) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (SELECT d.*, q.own, q.target, q.passes, q.target - q.passes * q.own AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS mid
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, own AS source_size, target,
    CASE WHEN own = 0 THEN 0 ELSE CAST(size * least(3, passes + CASE WHEN mid <= rest THEN 1 ELSE 0 END) AS BIGINT) END AS taken FROM c
"""
