"""Staged changes and the upload stream: failures, two writers, replays, late rows, restarts."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import mutations
from quillspark.operators.snapshots import Conflict, Refused, Store, replace_chunks
from quillspark.streaming import uploads

CHUNKS = "id long, article_id long, chunk_index int, content string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, f"file://{tmp_path}/store", buckets=8)
    chunks = spark.range(60).select("id", (F.col("id") % 20).alias("article_id"), F.floor(F.col("id") / 20).cast("int").alias("chunk_index"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("content"))
    with out.change() as c:
        c.create("article_chunks", chunks, "article_id")
    return out


def fresh(spark, held):
    return spark.createDataFrame(held, CHUNKS)


def test_replacement_is_the_plain_one(spark, store):
    before = store.latest()
    old = rows(store.read("article_chunks"))
    new = fresh(spark, [(100, 3, 0, "x"), (101, 3, 1, "y"), (102, 77, 0, "z")])
    want = rows(mutations.replaced_chunks(store.read("article_chunks"), new))
    after = replace_chunks(store, new)
    assert rows(store.read("article_chunks")) == want and after.number == before.number + 1
    assert rows(store.read("article_chunks", before)) == old  # who reads the old version goes on reading it
    same = {x["path"] for x in before.tables["article_chunks"]} & {x["path"] for x in after.tables["article_chunks"]}
    assert len(same) >= 6  # other buckets were not rewritten
    gone = replace_chunks(store, new.limit(0), spark.createDataFrame([(3,)], "article_id long"))
    assert store.read("article_chunks", gone).where("article_id = 3").count() == 0
    assert replace_chunks(store, new.limit(0)).number == gone.number  # nothing to change


@pytest.mark.parametrize("bad", [[(1, 3, 0, "a"), (2, 3, 0, "b")], [(1, 3, -1, "a")], [(1, 3, None, "a")], [(1, None, 0, "a")]])
def test_refused_rows_change_nothing(spark, store, bad):
    old = rows(store.read("article_chunks"))
    with pytest.raises(Refused):
        replace_chunks(store, fresh(spark, bad))
    assert rows(store.read("article_chunks")) == old and store.latest().number == 1
    with pytest.raises(Refused):
        replace_chunks(store, fresh(spark, [(1, 3, 0, "a")]), spark.createDataFrame([(4,)], "article_id long"))
    with pytest.raises(Refused, match="holds"), store.change() as c:
        c.replace("article_chunks", fresh(spark, [(1, 3, 0, "a")]).drop("content"), "article_id")


def folders(spark, store):
    fs, where = store._fs(), store._path("data")
    return {x.getPath().getName() for x in fs.listStatus(where)}


def test_failing_write_leaves_the_old_chunks(spark, store):
    old, held = rows(store.read("article_chunks")), folders(spark, store)
    broken = fresh(spark, [(1, 3, 0, "a"), (2, 5, 0, "b")]).withColumn("content", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"), store.change() as c:
        c.replace("article_chunks", broken, "article_id")
    assert rows(store.read("article_chunks")) == old and store.latest().number == 1
    assert folders(spark, store) == held  # what was written aside is gone


def test_of_two_writers_one_loses(spark, store):
    base = store.latest()
    with pytest.raises(Conflict), store.change(base) as slow:
        slow.replace("article_chunks", fresh(spark, [(1, 3, 0, "slow")]), "article_id")
        replace_chunks(store, fresh(spark, [(2, 3, 0, "quick")]), base=base)
    assert rows(store.read("article_chunks").where("article_id = 3"), "content") == [("quick",)]
    with pytest.raises(Conflict):
        replace_chunks(store, fresh(spark, [(3, 4, 0, "stale")]), base=base)
    # both check before either switches: the manifest can be created once
    one, two = store.latest(), store.latest()
    one.number = two.number = 3
    store._switch(one)
    with pytest.raises(Conflict):
        store._switch(two)


def test_manifest_of_a_dead_writer_is_passed_over(spark, store):
    stream = store._fs().create(store._path("manifests/000000000002.json"), False)
    stream.write(bytearray(b'{"tables": {"art'))
    stream.close()
    assert store.latest().number == 1
    assert replace_chunks(store, fresh(spark, [(9, 3, 0, "on")])).number == 3
    assert rows(store.read("article_chunks").where("article_id = 3"), "content") == [("on",)]


def test_vacuum_keeps_what_is_named(spark, store):
    for i in range(3):
        replace_chunks(store, fresh(spark, [(i, 3, 0, f"v{i}")]))
    want = rows(store.read("article_chunks"))
    assert store.vacuum(keep=2) >= 1
    assert rows(store.read("article_chunks")) == want and store.latest().number == 4
    assert rows(store.read("article_chunks", store._read(3)).where("article_id = 3"), "content") == [("v1",)]


# ---------------------------------------------------------------- uploads

T0 = datetime(2026, 1, 1, 12)


def upload(i, org, body, minutes=0, title="t"):
    return {"organization_id": org, "title": title, "body": body, "uploaded_at": (T0 + timedelta(minutes=minutes)).isoformat(), "upload_id": i}


def drop(folder, name, held):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(x) for x in held))


def run(spark, tmp_path, store, **how):
    query = uploads.started(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/checkpoint", files_per_batch=1, **how)
    query.awaitTermination()


def fates(store):
    return rows(store.read("articles"), "upload_id"), rows(store.read("late"), "upload_id", "fate")


def test_stream_restarts_and_fates(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    drop(tmp_path / "in", "a.json", [upload(1, 1, "x"), upload(2, 1, "x", 1), upload(3, 2, "x"), upload(4, 1, "  "), upload(5, None, "y"), upload(6, 1, "y", 100)])
    run(spark, tmp_path, store)
    assert fates(store) == ([(1,), (3,), (6,)], [(4, "invalid"), (5, "invalid")])
    # a later start goes on where the checkpoint ends; the mark is minute 100
    drop(tmp_path / "in", "b.json", [upload(7, 1, "x", 110), upload(8, 1, "z", 39), upload(9, 1, "w", 40), upload(10, 3, "x", 120)])
    run(spark, tmp_path, store)
    assert fates(store) == ([(1,), (3,), (6,), (9,), (10,)], [(4, "invalid"), (5, "invalid"), (8, "late")])
    number = store.latest().number
    run(spark, tmp_path, store)  # nothing new
    assert store.latest().number == number


def test_replayed_batch_changes_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    drop(tmp_path / "in", "a.json", [upload(1, 1, "x"), upload(2, 1, "y")])
    run(spark, tmp_path, store)
    want, number = fates(store), store.latest().number
    batch = spark.read.schema(uploads.UPLOADS).json(f"file://{tmp_path}/in")
    assert not uploads.apply_batch(store, batch, 0)
    assert (fates(store), store.latest().number) == (want, number)
    # the checkpoint is lost: all batches come again with their numbers
    uploads.started(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/other").awaitTermination()
    assert (fates(store), store.latest().number) == (want, number)


def test_batch_that_fails_is_applied_by_its_replay(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    drop(tmp_path / "in", "a.json", [upload(1, 1, "x")])
    real = Store._switch
    monkeypatch.setattr(Store, "_switch", lambda self, v: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, store)
    assert store.latest().number == 0
    monkeypatch.setattr(Store, "_switch", real)
    run(spark, tmp_path, store)
    assert fates(store) == ([(1,)], [])


def test_forgotten_hashes_are_still_repeats(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    batch = lambda held: spark.read.schema(uploads.UPLOADS).json(spark.sparkContext.parallelize([json.dumps(x) for x in held]))
    how = {"remember": timedelta(hours=2)}
    assert uploads.apply_batch(store, batch([upload(1, 1, "x")]), 0, **how)
    assert uploads.apply_batch(store, batch([upload(2, 1, "y", 500)]), 1, **how)
    assert rows(store.read("seen"), "organization_id").__len__() == 1  # the first batch's folder has timed out
    assert uploads.apply_batch(store, batch([upload(3, 1, "x", 510), upload(4, 1, "new", 511)]), 2, **how)
    assert fates(store)[0] == [(1,), (2,), (4,)]
    assert uploads.apply_batch(store, batch([]).limit(0), 3, **how)  # an empty batch moves the number on
    assert store.latest().notes["uploads"]["batch"] == 3


# ---------------------------------------------------------------- audit of changes


def tables_of(spark, state):
    return {
        "organizations": spark.createDataFrame(state["organizations"] or [], "id long, name string, code string"),
        "users": spark.createDataFrame(state["users"] or [], "id long, organization_id long, role string, email string"),
        "articles": spark.createDataFrame(state["articles"] or [], "id long, organization_id long, content_hash string, visibility string"),
        "user_articles": spark.createDataFrame(state["user_articles"] or [], "user_id long, article_id long"),
    }


def test_audit_of_changes_is_the_whole_audit(spark, tmp_path):
    import random

    from quillspark.operators import constraints

    rnd = random.Random(4)
    draw = {
        "organizations": lambda: (rnd.randrange(4), rnd.choice(["a", " b", "", None]), rnd.choice(["x", "y", None])),
        "users": lambda: (rnd.randrange(30), rnd.choice([0, 1, 7, None]), rnd.choice(["member", "admin", "boss", None]), rnd.choice(["e|1", "e2", None])),
        "articles": lambda: (rnd.randrange(30), rnd.randrange(5), rnd.choice(["h", "i ", None]), rnd.choice(["public", "open"])),
        "user_articles": lambda: (rnd.randrange(40), rnd.choice([None, *range(40)])),
    }
    state = {t: [f() for _ in range(40)] for t, f in draw.items()}
    store = Store(spark, f"file://{tmp_path}/audit", buckets=16)
    said = lambda df: sorted((r.table_name, r.rule, r.n) for r in df.collect())
    assert said(constraints.begin_audit(store, tables_of(spark, state))) == said(constraints.audit(tables_of(spark, state)))
    for step in range(4):
        gone = {t: rnd.sample(held, min(len(held), rnd.randrange(0, 12)) if step else len(held)) for t, held in state.items() if t != "organizations" or step == 2}
        new = {t: [draw[t]() for _ in range(rnd.randrange(0, 12))] for t in state if step != 1}
        for t in state:
            for r in gone.get(t, []):
                state[t].remove(r)
            state[t] = state[t] + new.get(t, [])
        every = {t: [] for t in state}
        pick = lambda part: {t: df for t, df in tables_of(spark, every | part).items() if t in part}
        assert said(constraints.audit_change(store, pick(new), pick(gone))) == said(constraints.audit(tables_of(spark, state))), step
    before = store.latest()
    assert said(constraints.audit_change(store, {}, {})) == said(constraints.audited(store))
    one = spark.createDataFrame([(1000, 1000)], "user_id long, article_id long")
    with pytest.raises(Refused, match="do not hold"):
        constraints.audit_change(store, {}, {"user_articles": one})
    assert store.latest().number == before.number
    constraints.audit_change(store, {"user_articles": one}, {})
    same = {x["path"] for x in before.tables["keys"]} & {x["path"] for x in store.latest().tables["keys"]}
    assert len(before.tables["keys"]) - 2 <= len(same) < len(before.tables["keys"]) + 1  # of 16 buckets those of two keys were read and rewritten


def test_stage_counts_in_one_pass(spark):
    from quillspark.plans import training

    df = spark.range(100).toDF("id")
    k = F.col("id")
    stages = [("a", F.when(k % 2 == 0, "even"), ("even", "odd")), ("b", F.when(k % 5 == 0, "five"), ("five",))]
    kept = []
    got = training.run_stages(df, stages, lambda out: kept.extend(r.id for r in out.collect()))
    assert rows(got.where("reason IS NOT NULL")) == [("a", "even", 50), ("b", "five", 10)]
    assert rows(got.where("reason IS NULL"), "stage", "n") == [("a", 50), ("b", 40)]
    assert sorted(kept) == [i for i in range(100) if i % 2 and i % 5]
    out, seen = training.observed_stages(df, stages)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1 and len(seen) == 2
    with pytest.raises(ValueError, match="not named"):
        training.run_stages(df, [("a", F.when(k == 3, "three"), ("four",))])
    assert rows(training.run_stages(df.limit(0), stages)) == []
