"""What holds only beyond the size of the test tables, on small tables made for it."""

import json
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import parsers, text
from quillspark.functions.periods import PERIOD_LABELS, bounds
from quillspark.operators import company, constraints, evaluation, order, vectors
from quillspark.plans import catalogue, catalogue_data, catalogue_scale  # noqa: F401
from quillspark.plans.views import Archive

SF = "/root/testdata/sf0.001"
TABLES = "nation supplier orders lineitem documents embeddings benchmark conversations".split()


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The test tables with an order in two moved by a million, to the supplier before: ids of conversations meet."""
    base = tmp_path_factory.mktemp("far")
    for name in TABLES:
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "lineitem":
            moved = df.where("l_suppkey > 0 AND l_orderkey % 2 = 0").withColumns({"l_orderkey": F.col("l_orderkey") + 1_000_000, "l_suppkey": F.col("l_suppkey") - 1})
            df = df.unionByName(moved)
        if name == "orders":
            df = df.unionByName(df.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000))
        df.write.parquet(f"{base}/{name}.parquet")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{base}/{name}.parquet/*.parquet')")
    return str(base), con


def agree(spark, far, name):
    base, con = far
    got = catalogue.QUERIES[name](spark, base)
    want = con.execute(f"select {', '.join(got.columns)} from ({catalogue.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["cascade_delete_user", "delete_articles"])
def test_messages_where_ids_of_conversations_meet(spark, far, name):
    t = catalogue._tables(Archive(spark, far[0]))["conversations"]
    assert t.select("id").distinct().count() < t.count()
    agree(spark, far, name)


def test_conversations_for_where_ids_meet(spark, far):
    agree(spark, far, "conversations_for")


def test_neighbours_in_blocks(spark):
    """Copies, odd vectors and queries that share an id, in blocks of a few rows, as a plain join gives them."""
    rnd = np.random.default_rng(3)
    held = [(i, i % 3, f"c{i}", [float(x) for x in rnd.normal(size=4)]) for i in range(60)]
    held += [(100 + i, 0, "copy", [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    odd = [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 0.0], [1e-170] * 4, [1e200] * 4, [1.0, 2.0]]
    held += [(200 + i, 0, "odd", v) for i, v in enumerate(odd)] + [(300, None, "none", [1.0] * 4)]
    chunks = spark.createDataFrame(held, "id long, article_id int, content string, embedding array<double>")
    asked = chunks.where("id % 7 = 0 OR id >= 100").select((F.col("id") % 290).alias("query_id"), F.col("embedding").alias("query_vector"), "article_id", F.lit("q").alias("said"))
    asked = asked.unionByName(asked.where("query_id < 20").withColumn("article_id", F.lit(2)))
    pairs = asked.join(chunks, ["article_id"]).withColumn("distance", vectors.cosine_distance(F.col("embedding"), F.col("query_vector"))).where("distance IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("long")
    want = pairs.drop("embedding", "query_vector").withColumn("nth", nth).where("nth <= 5")
    got = vectors.neighbours(asked, chunks, ["article_id"], 5, per_block=7, rows_per_task=20)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_places_of_long_texts_are_not_told_character_by_character(spark):
    """Symbols inside and about runs of white space, null, and a plan without functions of arrays over characters."""
    texts = [(0, None), (1, ""), (2, "△ 　a▲ \n◆\tb😀 ▲ "), (3, " \n"), (4, "ab\x1cc​ d"), (5, "x " * 5000)]
    df = spark.createDataFrame(texts, "id int, x string").select("id", text.normal_map(F.col("x")).alias("p"))
    got = {r.id: r.p for r in df.collect()}
    assert got == {0: None, 1: [], 2: [3, 5, 9, 10], 3: [], 4: [0, 1, 2, 3, 4, 5, 6], 5: list(range(9999))}
    asked = df.where(F.size("p") > 0)._jdf.queryExecution().executedPlan().toString()
    assert asked.count("ArrowEvalPython") == 1 and "lambda" not in asked


def test_dates_take_one_search(spark):
    texts = ["입력 1998년 6월 7일 오후 3:05", "1998-12-31 (목) 오전 12시", "a 1998.2.30 1998.3.1", "0000.1.1", "x", "1998/1/2 3:4", "1998.6.7. 24:00", "1998.06.07 오후 12:59 b 1999.1.1", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x string").select("id", parsers.published_at(F.col("x")).alias("at"))
    got = [r.at and str(r.at) for r in df.orderBy("id").collect()]
    assert got == ["1998-06-07 15:05:00", "1998-12-31 00:00:00", None, None, None, "1998-01-02 03:00:00", None, "1998-06-07 12:59:00", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1


def test_unique_keys_are_sorted(spark):
    links = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 1), (2, 1), (None, 1), (None, 1), (3, 3)], "user_id long, article_id long")
    got = constraints.audit({"user_articles": links})
    assert [tuple(r) for r in got.collect()] == [("user_articles", "user_id, article_id unique", 2)]
    assert "Aggregate [user_id" not in got._jdf.queryExecution().optimizedPlan().toString()  # no table of all keys


def test_answers_are_tidied_once(spark):
    asked = spark.createDataFrame([(1, 1, 0, "t", "판정: 충족\n이유: a"), (2, 1, 0, "t", None)], "article_id long, guideline_id long, item int, title string, raw string")
    got = evaluation.graded(asked, lambda q: q)
    assert [(r.verdict, r.reason) for r in got.orderBy("article_id").collect()] == [("충족", "a"), ("판정 실패", "")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("<think>") == 1


def test_keys_of_an_audit_are_counted_as_they_are(spark, tmp_path):
    """Keys are strings only once counted, no plan of theirs has a lambda or JSON; an id and its references are one kept row, written in small tasks."""
    from quillspark.operators.snapshots import Refused, Store

    users = spark.createDataFrame([(i, i % 3, f"{'a' * (i % 2)}|{i // 4}") for i in range(200)], "id long, organization_id long, email string")
    odd = spark.createDataFrame([(1, "1:a"), (1, "1:a"), (11, ":a"), (None, "x"), (2, None), (2, None)], "organization_id long, content_hash string").withColumn("id", F.lit(7).cast("long"))
    tables = {"organizations": spark.range(2), "users": users, "articles": odd}
    counts = constraints.key_counts(tables)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "lambda" not in plan and "to_json" not in plan
    store = Store(spark, f"file://{tmp_path}/audit", buckets=2)
    with store.change() as change:
        assert change.merge("keys", counts, "key", constraints.summed, rows_per_task=20) == [0, 1]
    files = [x.split("/")[-2] for x in store.read("keys").inputFiles()]
    assert min(files.count(b) for b in set(files)) > 3  # a bucket is several tasks'
    kept = {(r.space, r.key): (r.n, r.r0, r.r1) for r in store.read("keys").collect()}
    assert kept["id|organizations", "1"] == (1, 67, 2) and kept["id|organizations", "2"] == (0, 66, 2)
    want = {(r.table_name, r.rule): r.n for r in constraints.audit(tables).collect()}
    assert {k: n for k, n in constraints.broken(store.read("keys")).items() if n} == want
    fresh = Store(spark, f"file://{tmp_path}/other", buckets=2)
    constraints.begin_audit(fresh, tables)
    again = constraints.audit_change(fresh, {"users": users}, {"users": users})  # each row for itself
    assert {(r.table_name, r.rule): r.n for r in again.collect()} == want
    with pytest.raises(Refused, match="do not hold"):
        constraints.audit_change(fresh, {"users": users.limit(1)}, {"articles": odd.unionByName(odd)})


@pytest.mark.parametrize("held", [100_000, 1])
def test_last_rows_of_keys(spark, held):
    """Keys of two columns, null in keys and order, in tasks that hold all and in tasks that hold next to nothing."""
    rnd = np.random.default_rng(5)
    pick = lambda *xs: xs[rnd.integers(len(xs))]
    rows = [(pick("r", "s", None), pick(1, 2, None), pick(None, 1, 2, 3), i, f"t{i}") for i in map(int, rnd.permutation(2000))]
    df = spark.createDataFrame(rows, "a string, b int, at int, id long, title string").repartition(7)
    got = sorted(map(str, order.last_rows(df.select("title", "a", "b", "at", "id"), ["a", "b"], ["at", "id"], 4, "nth", held).select("a", "b", "at", "id", "title", "nth").collect()))
    want = []
    for key in {r[:2] for r in rows}:
        mine = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[3]), reverse=True)
        want += [(*r, i + 1) for i, r in enumerate(mine[:4])]
    schema = "a string, b int, at int, id long, title string, nth int"
    assert got == sorted(map(str, spark.createDataFrame(want, schema).collect()))
    assert order.last_rows(df.limit(0), ["a"], ["id"], 4, "nth").count() == 0


def test_company_answers_of_many_articles(spark):
    """Every period, with and without category, over articles with and without time, category and writer, some at one time; no task sorts them."""
    now = datetime(1998, 6, 17, 1)
    rnd = np.random.default_rng(6)
    pick = lambda *xs: xs[rnd.integers(len(xs))]
    days = [0, 0, 0, 1, 2, 3, 6, 7, 9, 16, 17, 20, 29, 30, 40, 100, 168, 169, 400, -1]
    rows = [(i, f"t{i}", pick(None, *[now - timedelta(days=d) for d in days]), pick(None, "경제", "정치"), pick(None, "가 7", "나 8"), pick(None, "m")) for i in range(600)]
    articles = spark.createDataFrame(rows, "id long, title string, published_at timestamp_ntz, category string, author string, media string").repartition(5)
    links = spark.createDataFrame([(1 + i % 2, i) for i in range(600)] + [(3, i) for i in range(0, 600, 4)], "user_id long, article_id long")
    users = spark.createDataFrame([(1, 10), (2, 20), (3, 10)], "id long, organization_id long")
    asked = [(i, name, period, category) for i in (2, 3) for name in ("list_recent_articles", "count_articles", "count_articles_by_category") for period in PERIOD_LABELS for category in (None, "경제", "문화")]
    told = [(i, json.dumps({"name": n, "arguments": {"period": p} | ({"category": c} if c and not n.endswith("category") else {})}, ensure_ascii=False)) for i, n, p, c in asked]
    named = spark.createDataFrame([], "id long, organization_id long, title string")
    questions = spark.createDataFrame([(k, i, "분야별 회사 기사" if "by_category" in raw else "회사 기사", raw) for k, (i, raw) in enumerate(told)], "ask_id long, article_id long, question string, raw string")
    out = company.answered(questions, articles, links, users, named, named, now)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.ask_id: r.answer for r in out.collect()}
    for k, (i, name, period, category) in enumerate(asked):
        span = bounds(period, now)
        own = [r for r in rows if r[0] % 2 == i % 2 and (span is None or (r[2] is not None and span[0] <= r[2] < span[1]))]
        label = PERIOD_LABELS[period]
        if name == "count_articles_by_category":
            by = sorted((-sum(r[3] == c for r in own), c or "미분류") for c in {r[3] for r in own})
            want = f"{label} 기준 회사 기사 분야별 개수입니다. (총 {len(own)}건)\n" + "\n".join(f"- {c}: {-n}건" for n, c in by) if own else f"{label} 기준 회사 기사가 없습니다."
        else:
            own = [r for r in own if category in (None, r[3])]
            about = f"{label}, {category or '전체 분야'} 기준"
            newest = sorted(own, key=lambda r: (r[2] is not None, r[2] or now, r[0]), reverse=True)[:5]
            lines = [f"{n}. {r[1]} ({r[2].strftime('%Y-%m-%d') if r[2] else '날짜 없음'})" for n, r in enumerate(newest, 1)]
            want = f"{about} 회사 기사는 {len(own)}건입니다." if name == "count_articles" else f"{about} 최근 회사 기사 {len(newest)}건입니다.\n" + "\n".join(lines) if own else f"{about} 회사 기사가 없습니다."
        assert got[k] == want, asked[k]
