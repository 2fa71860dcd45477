"""Manifests against a tree built in one loop."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle, queries

from test_llm import ODD, SMALL, docs_of, frame, lower


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    told = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(*(told(x) for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def brute_tree(nodes):
    """(root, path of each node): a path is a list of (digests before, digests after) of runs."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for i, p in enumerate(place):
            paths[i].append((runs[p // 8][: p % 8], runs[p // 8][p % 8 + 1 :]))
            place[i] = p // 8
        nodes = [h(*x) for x in runs]
    return (nodes[0] if nodes else None), paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, over = brute_tree([trees[g][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for (_, _, leaf, r), low in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            path = low + over[i]
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            node = brute_leaf(r, lower(r.text)) if bad else leaf
            for before, after in path:
                node = h(*before, node, *after)
            proof = h(*(x for before, after in path for x in (*before, *after)))
            out.append((r.doc_id, leaf, trees[g][0], root, proof, node, node == root))
    return sorted(out, key=str)


def told(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def manifest(df, **kw):
    return merkle.manifest(df, merkle.document_leaf(), offered=merkle.tampered_leaf(), **kw)


def test_whole_table(spark):
    assert told(queries.op11_merkle_manifest(spark, SMALL)) == brute_manifest(docs_of(spark, SMALL).collect())


def test_odd_rows_and_groups(spark):
    rows = [(*r, None if i % 3 else "", f"s{i}") for i, r in enumerate(ODD)] + [(i, f"Text {i}", "é", None) for i in range(70)] + [(99, "lone", "zz")]
    df = frame(spark, rows)
    got = manifest(df)
    assert told(got) == brute_manifest(df.collect())
    assert got.where("verified").count() > 0 < got.where("NOT verified").count()
    assert told(manifest(df.limit(0))) == []
    one = told(manifest(df.where("doc_id = 99")))
    assert one == brute_manifest(df.where("doc_id = 99").collect()) and one[0][1] == one[0][2] == one[0][3] and one[0][4] == h("")


def test_rounds_and_proofs(spark):
    rnd = random.Random(3)
    df = frame(spark, [(rnd.randrange(2000), f"Row {i % 700}", ("en", "de", None)[min(2, i % 40)]) for i in range(1200)])
    got = manifest(df, levels=1, most_tops=4, proofs=True).cache()
    assert told(got) == brute_manifest(df.collect())  # several rounds over blocks of eight, rows that agree in all
    again = got.select("verified", "root", "folded_root", merkle.fold(F.col("leaf"), F.col("proof")).alias("own"))
    assert all(r.own == r.root for r in again.collect())
    with pytest.raises(ValueError, match="groups"):
        manifest(df, most_groups=2)
