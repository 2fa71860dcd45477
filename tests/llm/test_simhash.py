"""Fingerprints and classes against all pairs on small tables."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import queries, simhash

from test_llm import ODD, SMALL, WORD, docs_of, frame, lower


def brute_print(text):
    w = WORD.findall(lower(text))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [0] * 64
    for x in s:
        v = xxhash.xxh64(x.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += v >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def brute_classes(rows):
    """(id, component_id) of (id, fingerprint)."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    every = np.array(prints, np.uint64)
    for f in prints:
        for g in every[np.bitwise_count(every ^ np.uint64(f)) <= 3].tolist():
            root[find(f)] = find(g)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, least.get(find(f))) for d, f in rows), key=str)


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def found(spark, rows, **kw):
    df = spark.createDataFrame([(d, signed(f), i) for i, (d, f) in enumerate(rows)], "id long, fp long, row long")
    return sorted(((r.id, r.component_id) for r in simhash.components(df, **kw).collect()), key=str)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in docs_of(spark, SMALL).collect()]
    want = dict((d, f"{brute_print(t):016x}") for d, t in docs)
    got = queries.op13_simhash_ball(spark, SMALL).collect()
    assert {r.doc_id: r.fingerprint for r in got} == want and len(got) == len(docs)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute_classes([(d, int(want[d], 16)) for d, _ in docs])


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in ODD] + [(20, "a  b"), (21, "A\tB "), (22, "ÄÖ x y z"), (23, "äö x y z")]
    got = simhash.near_classes(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d), f"{brute_print(t):016x}") for d, t in rows)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute_classes([(d, brute_print(t)) for d, t in rows])
    assert simhash.near_classes(frame(spark, []).limit(0)).collect() == []


def flipped(rnd, f, n):
    for b in rnd.sample(range(64), n):
        f ^= 1 << b
    return f


def test_every_distance_meets(spark):
    rnd = random.Random(13)
    rows = []
    for i in range(300):  # pairs at 0 to 5 bits, from even and odd fingerprints
        f = rnd.getrandbits(64)
        rows += [(10 * i + 1, f), (10 * i, flipped(rnd, f, i % 6))]
    assert found(spark, rows) == brute_classes(rows)
    assert found(spark, rows, per_cell=5) == brute_classes(rows)


def test_dense_cluster_chain_and_copies(spark):
    rnd = random.Random(31)
    base = rnd.getrandbits(64)
    low = [base ^ rnd.getrandbits(9) for _ in range(500)]  # hundreds within nine bits: all meet, and share their first bits
    chain = [rnd.getrandbits(64)]
    for _ in range(60):
        chain.append(flipped(rnd, chain[-1], 3))
    rows = [(i, f) for i, f in enumerate([*low, *chain, 0, 0, 1, 15, 240, (1 << 64) - 1])] + [(5000 - i, chain[7]) for i in range(400)] + [(None, 0), (None, chain[3]), (None, 0x0F0F0F0F0F0F0F0F)]
    want = brute_classes(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, per_cell=3, most=3000, step=5) == want  # cells are cut down to single variants
    assert found(spark, rows, rows_per_salt=50) == want


def test_entries_of_a_cell_cover_the_ball(spark):
    """An even fingerprint reaches itself and all 2,016 variants two bits away, an odd one its 64 neighbours, each once."""
    df = spark.createDataFrame([(0b11, 0, 2), (0b111, 0, 1)], "fp long, cell long, left int")
    cells = simhash.spread(df, 0, 6)
    counts = {r.fp: r.n for r in cells.groupBy("fp").agg(F.count("*").alias("n")).collect()}
    assert counts == {0b11: 1 + 6 + 15, 0b111: 1 + 6}
    again = simhash.spread(cells, 6, 6).groupBy("fp").agg(F.count("*").alias("n"), F.countDistinct("cell").alias("d")).collect()
    assert {r.fp: (r.n, r.d) for r in again} == {0b11: (1 + 12 + 66, 79), 0b111: (13, 13)}
