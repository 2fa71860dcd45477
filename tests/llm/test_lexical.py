"""Search against scores of all documents, one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import lexical, queries

from test_llm import ODD, SMALL, docs_of, frame, lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=50):
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(lower(text))) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def told(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def pairs(df, key):
    return [(r[key], r.text) for r in df.collect()]


def test_whole_table(spark):
    want = brute_search(pairs(docs_of(spark, SMALL), "doc_id"), pairs(spark.read.parquet(f"{SMALL}/benchmark.parquet"), "item_id"))
    assert told(queries.op12_impact_search(spark, SMALL)) == want


def random_case(spark, n=900):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    text = lambda m: " ".join(words[min(59, int(rnd.expovariate(0.09)))] for _ in range(m))
    docs = frame(spark, [(i // 2 * 2, text(rnd.randrange(1, 60))) for i in range(n)] + [(r[0], r[1]) for r in ODD])
    items = spark.createDataFrame([(i, text(rnd.randrange(1, 25))) for i in range(30)] + [(70, None), (71, "..."), (72, "absent"), (73, "ONE"), (73, "one"), (74, "テキスト")], "item_id int, text string")
    return docs, items


def test_blocks_ties_and_odd_rows(spark):
    docs, items = random_case(spark)  # short texts of few words: many ties
    want = brute_search(pairs(docs, "doc_id"), pairs(items.where("item_id < 73 OR text = 'one' OR item_id > 73"), "item_id"), k=7)
    assert told(lexical.search(docs, items, k=7)) == want
    assert told(lexical.search(docs, items, k=7, docs_per_block=16, terms_at_once=40, drawn=50)) == want
    assert told(lexical.search(docs, items, k=7, docs_per_block=1000, postings_per_block=50)) == want
    assert told(lexical.search(docs.limit(0), items)) == told(lexical.search(docs, items.limit(0))) == []


def test_search_stops_early_with_proof(spark):
    rnd = np.random.default_rng(4)
    docs, terms = 4000, 12
    held = rnd.random((docs, terms)) < np.linspace(0.02, 0.9, terms)
    held[:60, :6] = True
    row, term = np.nonzero(held)
    block = lexical.Block(rnd.integers(5, 50, docs), np.r_[0, np.cumsum(held.sum(1))], term, rnd.integers(1, 4, len(term)), np.linspace(8000, 100, terms).astype(np.int64), docs, docs * 25)
    real, seen = np.add.at, []
    try:
        np.add.at = lambda a, i, b: (seen.append(len(i)), real(a, i, b))[1]
        doc, score = block.search(np.arange(terms), 50, 1)
    finally:
        np.add.at = real
    full = np.bincount(row, block.gain, docs)
    best = np.sort(full)[-50]
    assert sum(seen[:-1]) < 0.8 * len(term)  # the last one completes candidates
    assert set(np.flatnonzero(full >= best)) <= set(doc.tolist()) and (full[doc] == score).all()


def test_bar_of_a_drawn_part_is_only_a_bound(spark):
    docs, items = random_case(spark, 300)
    assert told(lexical.search(docs, items, k=5, drawn=0)) == told(lexical.search(docs, items, k=5, drawn=10**6))


def test_terms_in_columns(spark):
    df = spark.createDataFrame([("A_b-C9 ÉÉ x z",)], "text string").select(lexical.terms_of(F.col("text")).alias("t"))
    assert df.first().t == TERM.findall(lower("A_b-C9 ÉÉ x z"))
