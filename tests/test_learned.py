"""Learned models on corpora with known truths, against the stand-ins; result files."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunking, learned, models
from quillspark.operators import neighbours
from quillspark.plans import settings, training
from quillspark.sources import files


def corpus(n=400, seed=1):
    """Texts of sentences that are known, some with abbreviations inside."""
    rnd = random.Random(seed)
    words = ["house", "river", "quickly", "minister", "paper", "green", "walks", "reads", "about", "never"]
    starts = ["The", "However", "Yesterday"]
    texts, truth = [], []
    for _ in range(n):
        own = []
        for _ in range(rnd.randrange(2, 6)):
            body = [rnd.choice(words) for _ in range(rnd.randrange(3, 8))]
            if rnd.random() < 0.4:
                body.insert(rnd.randrange(1, len(body)), rnd.choice(["Dr. Kim", "approx. 3.5", "e.g. Paris"]))
            own.append(" ".join([rnd.choice(starts), *body]) + rnd.choice([".", ".", "!"]))
        if rnd.random() < 0.3:
            own[-1] = own[-1][:-1] + " etc."
            own.append("However it ends.")
        truth.append(own)
        texts.append(" ".join(own))
    return texts, truth


def test_sentences_keep_learned_abbreviations_whole(spark):
    texts, truth = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    model = learned.fit_sentences(df)
    assert {"dr", "approx", "e.g", "etc"} <= set(model.abbreviations) and "house" not in model.abbreviations
    assert {"the", "however", "yesterday"} <= set(model.starters) and "kim" not in model.starters
    split = learned.splitter(model)
    got = {r.i: (r.a, r.b) for r in df.select("i", split(F.col("text")).alias("a"), chunking.sentences(F.col("text")).alias("b")).collect()}
    right = [sum(got[i][k] == want for i, want in enumerate(truth)) / len(truth) for k in (0, 1)]
    assert right[0] > 0.97 and right[1] < 0.5  # the stand-in cuts at every period
    odd = [None, "", " \n ", "one", "a.b c", "Is it? \"Yes.\" he said\nnew line. Dr.\nKim", "3.5 is more. The end"]
    out = [r.s for r in spark.createDataFrame(list(enumerate(odd)), "i int, t string").orderBy("i").select(split(F.col("t")).alias("s")).collect()]
    assert out == [[], [], [], ["one"], ["a.b c"], ["Is it?", '"Yes."', "he said", "new line.", "Dr.", "Kim"], ["3.5 is more.", "The end"]]
    assert learned.fit_sentences(df.limit(0)) == learned.SentenceModel((), ())
    chunks = df.select(F.explode(chunking.chunk(F.col("text"), 60, splitter=split)).alias("c")).where("length(c) <= 60 AND c LIKE '%Dr.'").count()
    assert chunks == 0  # chunks take it as their splitter, and no name is parted from its title


def test_scores_by_hand(spark):
    df = spark.createDataFrame([("No. no. x word word. Word",)], "text string")
    got = {r.word: r for r in learned.abbreviation_scores(df).collect()}
    assert (got["no"].n_dot, got["no"].n_bare, got["word"].n_dot, got["word"].n_bare) == (2, 0, 1, 2) and "x" not in got
    p = 3 / 6
    assert got["no"].score == pytest.approx(2 * (2 * math.log(0.99) - 2 * math.log(p)) * math.exp(-2))


def test_spacing_is_better_than_a_rule(spark):
    rnd = random.Random(5)
    syllables = "가나다라마바사아자차"
    stems = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(2, 4))) for _ in range(30)]
    word = lambda: rnd.choice(stems) + rnd.choice(["은", "는", "을", "에서", "했다"])
    lines = [" ".join(word() for _ in range(12)) for _ in range(600)]
    model = learned.fit_spacing(spark.createDataFrame([(x,) for x in lines[:500]], "text string")).cache()
    cases = []
    for i, line in enumerate(lines[500:]):
        at = rnd.randrange(1, len(line) - 1)
        left, right = line[:at].rstrip(), line[at:].lstrip()
        cases.append((i, left, right, line))
    df = spark.createDataFrame(cases, "i int, l string, r string, whole string")
    got = learned.glued(df, "l", "r", model, "out").collect()
    right = sum(r.out == r.whole for r in got) / len(cases)
    rule = sum(f"{a} {b}" == w for _, a, b, w in cases) / len(cases)
    assert right > 0.8 and right > rule + 0.2, (right, rule)
    odd = spark.createDataFrame([(1, None, "a"), (2, "a", ""), (3, None, None), (4, "brok=", "en"), (5, "☃", "☂")], "i int, l string, r string")
    assert [r.out for r in learned.glued(odd, "l", "r", model, "out").orderBy("i").collect()] == ["a", "a", "", "brok=en", "☃ ☂"]


def test_pairs_of_whole_texts(spark):
    texts = ["ab c", "a\tb", None, "", "é é", "a  b", "ca"]
    want = {("a", "b"): (1, 0), ("b", "c"): (0, 1), ("é", "é"): (0, 1), ("c", "a"): (1, 0)}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {(r.a, r.b): (r.n_joined, r.n_spaced) for r in learned.fit_spacing(df).collect()} == want
    long = "ab cd" * 2000
    counts = lambda parts: {(r[0], r[1]): (r[2], r[3]) for b in parts for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([long])], ["text"])
    total: dict = {}
    for part in learned._pairs(iter([batch]), at_once=333):
        for key, n in counts([part]).items():
            total[key] = tuple(map(sum, zip(total.get(key, (0, 0)), n, strict=True)))
    assert total == counts(learned._pairs(iter([batch])))  # cut anywhere, each pair counts once


def test_vectors_bring_edited_copies_near(spark):
    rnd = random.Random(7)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(3000)]
    base = [[rnd.choice(common) for _ in range(60)] + rnd.sample(rare, 12) for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):  # a copy with other common words and a few rare ones gone
        copy = [rnd.choice(common) for _ in range(60)] + w[60:69]
        rnd.shuffle(copy)
        rows.append((1000 + i, " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, "!!")]
    df = spark.createDataFrame(rows, "id long, text string")
    model = learned.fit_embedder(df)
    trained = learned.embedded(df, F.col("text"), model).cache()
    plain = df.select("id", "text", models.embed(F.col("text")).alias("embedding"))

    def found(vectors):
        index = neighbours.build(vectors.select("id", "embedding"), [])
        asked = vectors.where("id < 1000").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
        return neighbours.exact(asked, index, [], 3).where("id = query_id + 1000").count() / 150

    good, stand_in = found(trained), found(plain)
    assert good > 0.95 and good > stand_in + 0.2, (good, stand_in)
    length = {r.id: r.n for r in trained.select("id", F.aggregate("embedding", F.lit(0.0), lambda m, x: m + x * x).alias("n")).collect()}
    assert length[5000] == length[5001] == length[5002] == 0 and all(abs(length[i] - 1) < 1e-5 for i in range(150))
    clash = df.withColumns({"slots": F.lit(1), "embedding": F.lit("old"), "c0": F.lit(2)})
    assert learned.embedded(clash, F.col("text"), model).columns == ["id", "text", "slots", "c0", "embedding"]
    assert learned.embedded(df.limit(0), F.col("text"), model).count() == 0
    assert np.allclose(learned.fit_embedder(df.limit(0)).weights, 0)


def test_array_files(spark, tmp_path):
    rows = [(i, None if i % 3 else "a", i % 2) for i in range(25)]
    df = spark.createDataFrame(rows, "id int, text string, kind int")
    files.write_array(df, f"file://{tmp_path}/one", ["id"])
    parts = sorted((tmp_path / "one").glob("part-*"))
    assert len(parts) == 1 and [tuple(r.values()) for r in json.loads(parts[0].read_text())] == rows
    files.write_array(df, f"file://{tmp_path}/many", ["id"], rows_per_file=7)
    parts = sorted((tmp_path / "many").glob("part-*"))
    assert len(parts) > 2 and [tuple(r.values()) for r in json.loads("".join(p.read_text() for p in parts))] == rows
    files.write_array(df.limit(0), f"file://{tmp_path}/none", ["id"])
    assert json.loads(next((tmp_path / "none").glob("part-*")).read_text()) == []
    got = files.save_results({"training": df, "golden": df.where("id < 3")}, f"file://{tmp_path}/sets", ["id"], "kind")
    assert sorted(map(tuple, got.collect())) == [("golden", 0, 2), ("golden", 1, 1), ("training", 0, 13), ("training", 1, 12)]
    some = training.extract_required(df, 5, "42", f"file://{tmp_path}/required")
    held = json.loads(next((tmp_path / "required").glob("part-*")).read_text())
    assert sorted(r.id for r in some.collect()) == [x["id"] for x in held] and len(held) == 5
    with pytest.raises(ValueError, match="fewer"):
        training.extract_required(df, 50, "42", f"file://{tmp_path}/toomany")


def test_files_of_several_lines_are_read_whole(spark, tmp_path):
    (tmp_path / "s.json").write_text('{\n "seed": 7,\n "sizes": {"training": 3}\n}')
    assert settings.settings(spark, f"file://{tmp_path}/s.json").seed == 7
    (tmp_path / "a.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    (tmp_path / "b.json").write_text('[\n {"a": 1},\n')
    got = files.file_errors(spark, {"training": f"file://{tmp_path}/a.json", "golden": f"file://{tmp_path}/b.json"})
    assert [(r.split, r.message) for r in got.collect()] == [("golden", "not JSON")]


def test_replacements_end_where_turns_would(spark):
    import hashlib

    rnd = random.Random(11)
    removed = [(i, rnd.choice("ab"), rnd.choice(["x", "y"])) for i in range(60)]
    pool = [(1000 + i, rnd.choice("ab"), rnd.choice(["x", "x", "y"])) for i in range(150)]
    taken, want = set(), {}
    for r, g, c in removed:  # taking turns
        order = sorted((p for p in pool if p[1] == g), key=lambda p: (p[2] != c, hashlib.sha256(f"42-golden-replace-{r}-{p[0]}".encode()).hexdigest()))
        want[r] = next(p[0] for p in order if p[0] not in taken)
        taken.add(want[r])
    frames = [spark.createDataFrame(x, "id long, grp string, category string") for x in (removed, pool)]
    for depth in (2, 16):
        assert {r.removed_id: r.id for r in training.replacements(*frames, "42", depth=depth).collect()} == want
    with pytest.raises(ValueError, match="no replacement"):
        training.replacements(frames[0], frames[1].where("grp = 'a'"), "42")
    with pytest.raises(ValueError, match="no replacement"):
        training.replacements(frames[0], frames[1].limit(20), "42", depth=2)
    assert training.replacements(frames[0].limit(0), frames[1], "42").count() == 0
