"""Nearest neighbours of many vectors through cells, exactly or nearly, without forming all pairs of a scope.

Centroids, fitted on a bounded sample, cut the unit sphere into cells; every row belongs to the cell of its nearest centroid and
keeps its angle to it. By the triangle inequality on angles, a cell whose rows lie ``near`` to ``far`` from its centroid
holds nothing closer to a query at angle ``a`` from the centroid than ``max(a - far, near - a)``, and nothing farther than ``a + far``.

* ``exact``: a query first visits the cells that surely hold ``k`` rows within the least angle; the k-th of these is its bar,
  and it visits only those other cells that may hold something closer.
* ``approximate``: a query visits the cells of its ``probes`` nearest centroids.

Visits and rows meet by (scope, cell); cells with many rows and scopes with many queries are cut into blocks, so no group grows with a
scope. Distances of what is found are summed in the order of ``vectors.cosine_distance`` and agree with it to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import saved

EPS = 1e-9  # far above the rounding of a cosine, far below what tells vectors apart


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; a null or empty table gives no rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products, one dimension after the other."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out = out + a[:, i] * b[:, i]
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - in_turn(a, b) / (np.sqrt(in_turn(a, a)) * np.sqrt(in_turn(b, b)))


@dataclass
class Index:
    """``rows``: (scope, id, cell, angle, embedding) of every vector that has a direction; ``centroids``: unit vectors."""

    centroids: np.ndarray
    rows: DataFrame


def fitted(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of about equal cells: spherical k-means from rows spread over the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(1))
        centroids = np.where(size[:, None] > EPS, sums / np.maximum(size, EPS)[:, None], centroids)
    return centroids


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = unit(matrix(batch.column(2))) @ centroids.T if batch.num_rows else np.zeros((0, 1))
            cell = cosine.argmax(1)
            angle = angles(cosine[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle), batch.column(2)], ["scope", "id", "cell", "angle", "embedding"])

    return run


def _scope(columns: list[str]):
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("")


def _directed(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction: not null, without nulls, not of length 0."""
    v = F.col(vector)
    return df.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0))


def build(chunks: DataFrame, scope: list[str], id_col: str = "id", vector: str = "embedding", cells: int | None = None, sample: int = 20_000) -> Index:
    """An index over every row of ``chunks``. Centroids are fitted on at most about ``sample`` rows, the smallest by a digest of their id;
    ``cells``: their number, by default half the root of the number of rows, 1,024 at most.

    Defined cases: null vectors, vectors with nulls and vectors of length 0 have no direction and are no one's neighbours; rows
    that repeat an id or a vector are rows of their own; an empty table gives an index without rows.
    """
    rows = _directed(chunks, vector).select(_scope(scope).alias("scope"), F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("embedding"))
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("embedding").limit(2 * sample)
    vectors = unit(matrix(drawn.toArrow().column("embedding")))
    cells = cells or max(1, min(1024, int(n**0.5 / 2)))
    centroids = fitted(vectors, cells) if len(vectors) else np.zeros((1, 1))
    return Index(centroids, saved(rows.mapInArrow(_assigned(centroids), "scope string, id long, cell int, angle double, embedding array<float>"), "index"))


# ---------------------------------------------------------------- which cells a query visits


def _planned(centroids: np.ndarray, k: int, probes: int | None):
    """(query_id, scope, query_vector, cell, lower, first): the cells of the scope by the least angle that their rows may have. ``first``: the
    cells to visit before there is a bar - those that surely hold k rows within the least angle, or the ``probes`` nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held = row.column(3)[0].values
                cell, n, near, far = (held.field(f).to_numpy() for f in ("cell", "n", "near", "far"))
                a = angles(unit(matrix(row.column(2))) @ centroids.T)[0][cell]
                if probes is None:
                    order = np.argsort(a + far, kind="stable")
                    first = np.zeros(len(cell), bool)
                    first[order[: int(np.searchsorted(np.cumsum(n[order]), min(k, n.sum()))) + 1]] = True
                    lower = np.maximum(0, np.maximum(a - far, near - a))
                else:
                    cell, lower, first = (x[np.argsort(a, kind="stable")[:probes]] for x in (cell, a, np.ones(len(cell), bool)))
                m = len(cell)
                same = [row.column(c).take(pa.array(np.zeros(m, np.int32))) for c in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(cell.astype(np.int32)), pa.array(lower), pa.array(first)], ["query_id", "scope", "query_vector", "cell", "lower", "first"])

    return run


def visits(queries: DataFrame, index: Index, scope: list[str], k: int, probes: int | None = None) -> DataFrame:
    """The cells of its scope that each query (query_id, query_vector, scope columns) may visit, a row each."""
    cells = index.rows.groupBy("scope", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
    held = cells.groupBy("scope").agg(F.collect_list(F.struct("cell", "n", "near", "far")).alias("cells"))  # one entry a centroid at most
    asked = _directed(queries, "query_vector").select(F.col("query_id"), _scope(scope).alias("scope"), F.col("query_vector").cast("array<float>").alias("query_vector"))
    return asked.join(held, "scope").select("query_id", "scope", "query_vector", "cells").mapInArrow(_planned(index.centroids, k, probes), "query_id long, scope string, query_vector array<float>, cell int, lower double, first boolean")


# ---------------------------------------------------------------- where visits meet rows


def _met(k: int, pairs_at_once: int = 4_000_000):
    """(query_id, scope, id, distance): of every visited block the k nearest rows, and those as near, unless the bar excludes them."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            b, q = matrix(rows.column("embedding")), matrix(asked.column("query_vector"))
            ub, uq, bar = unit(b), unit(q), asked.column("bar").to_numpy()
            keys, of = np.unique(np.r_[rows.column("place").to_numpy(zero_copy_only=False).astype(str), asked.column("place").to_numpy(zero_copy_only=False).astype(str)], return_inverse=True)
            by_row, by_query = np.argsort(of[: len(b)], kind="stable"), np.argsort(of[len(b) :], kind="stable")
            row_at, query_at = (np.searchsorted(x, np.arange(len(keys) + 1)) for x in (np.sort(of[: len(b)]), np.sort(of[len(b) :])))
            for i in range(len(keys)):
                mine, theirs = by_row[row_at[i] : row_at[i + 1]], by_query[query_at[i] : query_at[i + 1]]
                step = max(1, pairs_at_once // max(1, len(mine)))
                for at in range(0, len(theirs) if len(mine) else 0, step):
                    some = theirs[at : at + step]
                    cosine = uq[some] @ ub[mine].T
                    least = np.partition(cosine, len(mine) - k, axis=1)[:, len(mine) - k] if len(mine) > k else np.full(len(some), -2.0)
                    r, c = np.nonzero(cosine >= np.maximum(least, bar[some])[:, None] - EPS)
                    found.append((some[r], mine[c], distances(b[mine[c]], q[some[r]])))
        r, c, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([asked.column("query_id").take(pa.array(r)), asked.column("scope").take(pa.array(r)), rows.column("id").take(pa.array(c)), pa.array(d)], ["query_id", "scope", "id", "distance"])

    return run


def _searched(index: Index, asked: DataFrame, k: int, rows_per_block: int, rows_per_task: int = 200_000) -> DataFrame:
    """The nearest rows of every visit (query_id, scope, query_vector, cell, bar)."""
    spark = index.rows.sparkSession
    cut = lambda n: F.ceil(F.col(n) / rows_per_block).cast("int")
    cells = index.rows.groupBy("scope", "cell").agg(F.count("*").alias("rows")).join(asked.groupBy("scope", "cell").agg(F.count("*").alias("asked")), ["scope", "cell"])
    cells = saved(cells.select("scope", "cell", "rows", "asked", cut("rows").alias("row_blocks"), cut("asked").alias("query_blocks")), "visited-cells")
    total = cells.agg(F.coalesce(F.sum(F.col("rows") * F.col("query_blocks") + F.col("asked") * F.col("row_blocks")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_task))
    blocks = cells.select("scope", "cell", "row_blocks", "query_blocks")

    def placed(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
        # a row's block follows from its key, and it meets every block of the other side
        df = df.join(blocks, ["scope", "cell"]).withColumn("mine", F.pmod(F.xxhash64(key), own)).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        row, query = ("mine", "theirs") if own == "row_blocks" else ("theirs", "mine")
        place = F.concat_ws("/", "cell", row, query, "scope")
        return df.withColumn("place", place).withColumn("task", F.pmod(F.xxhash64("place"), F.lit(tasks)))

    left = placed(index.rows, "row_blocks", "query_blocks", "id").select("task", "place", "id", "embedding")
    right = placed(asked, "query_blocks", "row_blocks", "query_id").select("task", "place", "query_id", "scope", "query_vector", "bar")

    met = _met(k)
    return left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(met, "query_id long, scope string, id long, distance double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "scope").orderBy("distance", "id")
    return found.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= k)


def _started(queries: DataFrame, index: Index, scope: list[str], k: int, rows_per_block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What first visits find; then the further visits that may find something closer, with their bars, and all visits."""
    plan = saved(visits(queries, index, scope, k), "visits")
    first = saved(_searched(index, plan.where("first").withColumn("bar", F.lit(-2.0)), k, rows_per_block), "first-found")
    worst = _ranked(first, k).groupBy("query_id", "scope").agg(F.max(F.when(F.col("nth") == k, F.col("distance"))).alias("worst"))
    rest = plan.where("NOT first").join(worst, ["query_id", "scope"], "left").withColumn("bar", 1 - F.coalesce("worst", F.lit(3.0))).drop("worst")
    # no row of a cell is closer than ``lower``; the rounding of an angle near 0 is the root of that of its cosine
    return first, rest.where(F.cos("lower") >= F.col("bar") - 1e-6), plan


def exact(queries: DataFrame, index: Index, scope: list[str], k: int, rows_per_block: int = 20_000) -> DataFrame:
    """(query_id, id, distance, nth): the rows of ``vectors.neighbours``, by distance and id, for queries with ids of their own.

    Defined cases: a query without direction has no neighbours; a scope without rows gives none; fewer than ``k`` rows are all given.
    """
    first, rest, _ = _started(queries, index, scope, k, rows_per_block)
    return _ranked(first.unionByName(_searched(index, rest, k, rows_per_block)), k).drop("scope")


def approximate(queries: DataFrame, index: Index, scope: list[str], k: int, probes: int, rows_per_block: int = 20_000) -> DataFrame:
    """What ``exact`` gives, as far as the cells of the ``probes`` nearest centroids hold it; distances are exact."""
    asked = visits(queries, index, scope, k, probes).withColumn("bar", F.lit(-2.0))
    return _ranked(_searched(index, saved(asked, "visits"), k, rows_per_block), k).drop("scope")


def calibrated(queries: DataFrame, index: Index, scope: list[str], k: int, recall: float = 0.95, most: int = 200) -> int:
    """The fewest probes with which at most about ``most`` queries, by a digest of their ids, find ``recall`` of their exact neighbours."""
    n = queries.count()
    some = saved(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, n // most))) == 0), "calibration")
    true = exact(some, index, scope, k).select("query_id", "id").join(index.rows.select("id", "cell"), "id")
    order = Window.partitionBy("query_id", "scope").orderBy("lower", "cell")
    near = visits(some, index, scope, k, len(index.centroids)).withColumn("probe", F.row_number().over(order)).select("query_id", "cell", "probe")
    found = true.join(near, ["query_id", "cell"]).groupBy("probe").agg(F.count("*").alias("n")).orderBy("probe").collect()
    wanted, held = recall * sum(r["n"] for r in found), 0
    for r in found:
        held += r["n"]
        if held >= wanted:
            return r["probe"]
    return len(index.centroids)


def pairs(queries: DataFrame, index: Index, scope: list[str], k: int, rows_per_block: int = 20_000) -> DataFrame:
    """(all_pairs, formed): pairs of queries and rows of their scopes, and how many of them ``exact`` forms."""
    _, rest, plan = _started(queries, index, scope, k, rows_per_block)
    sizes = index.rows.groupBy("scope", "cell").agg(F.count("*").alias("n"))
    held = plan.select("scope", "cell", F.col("first").alias("formed")).unionByName(rest.select("scope", "cell", F.lit(None).cast("boolean").alias("formed")))
    # rest is told a second time, with null
    return held.join(sizes, ["scope", "cell"]).agg(F.sum(F.when(F.col("formed").isNotNull(), F.col("n"))).alias("all_pairs"), F.sum(F.when(F.coalesce("formed", F.lit(True)), F.col("n"))).alias("formed"))
