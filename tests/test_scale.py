"""Paths that hold at scale, against the plain ones on small tables."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import neighbours, order, storage, vectors
from quillspark.plans import training, validation

CHUNKS = "id long, article_id long, embedding array<float>"


def clustered(n=3000, spots=40, dim=16, seed=1):
    """Vectors around a few directions, a third of all rows in one scope, with repeats and vectors without direction."""
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(spots, dim))
    x = centre[rnd.integers(0, spots, n)] + 0.05 * rnd.normal(size=(n, dim))
    x[10:14] = x[10]
    rows = [(i, int(0 if i % 3 == 0 else 1 + i % 7), [float(v) for v in x[i].astype(np.float32)]) for i in range(n)]
    return rows + [(n, 0, [0.0] * dim), (n + 1, 0, None), (n + 2, 1, [None] * dim), (n + 3, 99, rows[5][2]), (n + 4, None, rows[6][2])]


def rows_of(df):
    return sorted((r.query_id, r.id, r.distance, r.nth) for r in df.select("query_id", "id", "distance", "nth").collect())


def asked(chunks, where="id % 50 = 0 OR id >= 3000"):
    return chunks.where(where).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), "article_id")


def test_exact_neighbours_form_few_pairs(spark):
    chunks = spark.createDataFrame(clustered(), CHUNKS).cache()
    plain = vectors.neighbours(asked(chunks), chunks.where("embedding IS NOT NULL AND embedding[0] IS NOT NULL"), ["article_id"], 7)
    want = [x for x in rows_of(plain) if x[0] != 3004]  # a plain join leaves the null scope out
    index = neighbours.build(chunks, ["article_id"], cells=40)
    assert index.rows.count() == 3002
    got = rows_of(neighbours.exact(asked(chunks), index, ["article_id"], 7))
    assert [x for x in got if x[0] != 3004] == want  # distances to the last bit
    assert [x[1] for x in got if x[0] == 3004] == [3004]  # null is a scope like others
    assert rows_of(neighbours.exact(asked(chunks), index, ["article_id"], 7, rows_per_block=9)) == got  # blocks on both sides
    formed = neighbours.pairs(asked(chunks), index, ["article_id"], 7).head()
    assert formed.formed < 0.3 * formed.all_pairs


def test_index_recall_and_calibration(spark):
    chunks = spark.createDataFrame(clustered(), CHUNKS).cache()
    queries = asked(chunks)
    index = neighbours.build(chunks, ["article_id"], cells=40, sample=500)  # fitted on a part, over every row
    true = {x[:2] for x in rows_of(neighbours.exact(queries, index, ["article_id"], 7))}
    probes = neighbours.calibrated(queries, index, ["article_id"], 7)
    near = {x[:2] for x in rows_of(neighbours.approximate(queries, index, ["article_id"], 7, probes))}
    assert probes < 40 and len(true & near) >= 0.9 * len(true)
    assert {x[:2] for x in rows_of(neighbours.approximate(queries, index, ["article_id"], 7, 40))} == true


def test_neighbours_of_nothing(spark):
    chunks = spark.createDataFrame(clustered(60), CHUNKS)
    index = neighbours.build(chunks.limit(0), ["article_id"])
    assert rows_of(neighbours.exact(asked(chunks, "id < 3"), index, ["article_id"], 3)) == []
    index = neighbours.build(chunks, [])
    assert rows_of(neighbours.exact(asked(chunks, "id < 0"), index, [], 3)) == []
    assert len(rows_of(neighbours.exact(asked(chunks, "id = 7"), index, [], 100))) == 62  # fewer than k


def test_numbered_in_groups(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(5), i % 40) for i in range(2000)] + [("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, k int, id int")
    got = order.numbered(df, ["k", "id"], "nth", 1, ["g"], "n", rows_per_task=150).collect()
    assert sorted((r.g or "", r.k if r.k is not None else -1, r.id) for r in got) == sorted((g or "", k if k is not None else -1, i) for g, k, i in rows)
    for g in ("a", "b", "c", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.nth)
        assert [r.nth for r in mine] == list(range(1, len(mine) + 1)) and {r.n for r in mine} == {len(mine)}
        keys = [(r.k is not None, r.k or 0, r.id) for r in mine]
        assert keys == sorted(keys)
    same = spark.range(1000).select(F.lit("x").alias("g"), F.lit(1).alias("k"))  # one group, one value
    assert sorted(r.nth for r in order.numbered(same, ["k"], "nth", 0, ["g"], rows_per_task=100).collect()) == list(range(1000))


def test_no_window_over_a_group_of_rows(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).alias("g"))
    for plan in (training.interleaved(df, "s", "g"), training.in_order(df, "s", "g"), validation.quartiles(df, "id", "g"), validation.outliers(df, "id", "g")):
        assert plan.count() >= 0
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in text and "rank(" not in text


def test_ranks_by_buckets(spark):
    rnd = random.Random(6)
    groups = {"wide": [rnd.choice([-1e9, 1e9]) * rnd.random() ** 9 for _ in range(700)], "one": [4.0] * 300, "two": [1.0, 2.0], "lone": [3.0], "near": [1 + i * 2**-52 for i in range(50)], None: [float(i % 9) for i in range(90)]}
    rows = [(g, v) for g, held in groups.items() for v in held] + [("lone", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    values = order.counted(df, "v", "g")
    wanted = spark.createDataFrame([(g, i + 1) for g, held in groups.items() for i in range(0, len(held), 7)], "grp string, rank long")
    for buckets in (2, 1024):
        got = {(r.grp, r["rank"]): r.v for r in order.at_ranks(values, wanted, buckets).collect()}
        assert got == {(g, i + 1): sorted(held)[i] for g, held in groups.items() for i in range(0, len(held), 7)}
    assert order.at_ranks(values, wanted.limit(0)).count() == 0
    q = {r.grp: r for r in validation.quartiles(df, "v", "g").collect()}
    assert set(q) == {"wide", "one", "two", "near", None}
    for g in q:
        assert [q[g].q1, q[g].q2, q[g].q3] == pytest.approx(statistics.quantiles(groups[g], n=4)) and q[g].n == len(groups[g])


def test_first_rows_of_each_key(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["r", "s", None]), rnd.choice([None, "x", "é", "y"]), str(rnd.randrange(100))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "rule string, split string, id string").repartition(7)
    for held in (100_000, 1):
        got = {r.rule: (r.n, [tuple(x) for x in r.firsts]) for r in order.first_per_key(df, "rule", ["split", "id"], 5, held_rows=held, parts=3).collect()}
        for key in ("r", "s", None):
            mine = sorted(((b is not None, b or "", c) for a, b, c in rows if a == key))
            assert got[key] == (len(mine), [(b if there else None, c) for there, b, c in mine[:5]])
    assert order.first_per_key(df.limit(0), "rule", ["id"], 5).count() == 0


def test_saved_tables_go_with_their_block(spark):
    import os

    with storage.temporary(spark):
        kept = storage.saved(spark.range(5), "outer")
        with storage.temporary(spark):
            path = storage.saved(spark.range(3), "inner").inputFiles()[0]
        assert kept.count() == 5 and not os.path.exists(path.removeprefix("file://"))
        path = kept.inputFiles()[0]
    assert not os.path.exists(path.removeprefix("file://"))
    assert storage.saved(spark.range(2)).count() == 2


@pytest.mark.parametrize("name", ["knn_pruned", "knn_index_recall", "chunk_rows_in_sql", "audit_of_changes", "staged_replacement", "streamed_uploads", "feature_messages", "article_evaluations", "training_messages", "abbreviation_scores", "spacing_pairs", "copies_by_vector", "upload_gate", "chunk_arguments", "admin_codes", "array_files"])
def test_queries_against_their_sql(spark, name):
    import glob
    import os

    import duckdb

    from quillspark.plans import catalogue, catalogue_scale  # noqa: F401  the second adds to the first

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    told = con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in told.description]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else [tidy(x) for x in v] if isinstance(v, (list, tuple)) else v
    got = catalogue.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr([tidy(r[c]) for c in names]) for r in got.collect()) == sorted(repr([tidy(x) for x in r]) for r in told.fetchall())
