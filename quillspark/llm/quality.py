"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed feature is shared by all grades; ordered thresholds cut the score into grades:
P(grade >= j) = sigmoid(score - threshold_j). The model gives the expected grade and the tail probabilities that
selection uses. Features are the words of the whole text (A-Z as a-z), their shapes (what they begin and end with), and
how much the text repeats itself; a text's word counts enter as 1 + log, its shapes as shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, run_hashes, small_batches, string_blocks, tokens

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Classes of a byte for shapes: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other ASCII mark, 6 beyond ASCII.
CLASS = np.zeros(256, np.int64)
CLASS[33:127] = 5
CLASS[48:58], CLASS[65:91], CLASS[97:123], CLASS[128:] = 3, 2, 1, 6
CLASS[[ord(x) for x in ".,;:!?'\"()-"]] = 4
SHAPES = 7 * 7 * 7 + 8


@dataclass
class Ordinal:
    words: np.ndarray  # one weight per bucket
    shapes: np.ndarray
    thresholds: np.ndarray  # ascending; one less than grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def _features(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs with their counts, and a dense row of shapes for each text."""
    rows = len(off) - 1
    gap = ~ALNUM[data]
    s, e, n = tokens(data, off, gap)
    bucket = (run_hashes(data, s, e, gap) % np.uint64(buckets)).astype(np.int64)
    row = np.repeat(np.arange(rows), n)
    pair, count = np.unique(row * buckets + bucket, return_counts=True)
    s, e, n = tokens(data, off, WHITE[data])
    shapes = np.zeros((rows, SHAPES), np.float32)
    if len(s):
        shape = CLASS[data[s]] * 49 + CLASS[data[e - 1]] * 7 + CLASS[data[np.maximum(s, (s + e) // 2)]]
        who = np.repeat(np.arange(rows), n)
        at, c = np.unique(who * SHAPES + shape, return_counts=True)
        shapes[at // SHAPES, at % SHAPES] = c / n[at // SHAPES]
        h = run_hashes(data, s, e)
        same = (h[1:] == h[:-1]) & (who[1:] == who[:-1])
        shapes[:, -8] = np.bincount(who[1:][same], minlength=rows) / np.maximum(n, 1)
        shapes[:, -7] = np.log1p(n) / 10
        shapes[:, -6] = n < 20
    lines = np.r_[0, np.cumsum(data == 10)]
    shapes[:, -5] = np.diff(lines[off]) / np.maximum(n, 1)
    return pair // buckets, pair % buckets, count, shapes


def _examples(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for _, to_, data, off in string_blocks(batch.column(1)):
                row, bucket, count, shapes = _features(data, off, buckets)
                cut = np.searchsorted(row, np.arange(len(off)))
                held += [(bucket[a:b].astype(np.int32).tobytes(), count[a:b].astype(np.int32).tobytes(), shapes[i].tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in held], pa.binary()) for i in range(3))], ["grade", "buckets", "counts", "shapes"])

    return run


def fit_ordinal(bucket: np.ndarray, value: np.ndarray, length: np.ndarray, shapes: np.ndarray, grade: np.ndarray, grades: int, buckets: int, least: int = 4, steps: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood; thresholds stay ordered through the logs of their distances.

    Words seen in under ``least`` texts keep weight 0. With under two grades present all weights are 0.
    """
    rows = len(length)
    seen = np.bincount(bucket, minlength=buckets)
    names = np.flatnonzero(seen >= least)
    place = np.full(buckets, -1)
    place[names] = np.arange(len(names))
    row = np.repeat(np.arange(rows), length)
    ok = place[bucket] >= 0
    row, col, x = row[ok], place[bucket[ok]], value[ok]
    count = np.bincount(grade, minlength=grades) + 0.5
    above = np.cumsum(count[::-1])[::-1][1:] / count.sum()
    first = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    p = np.r_[np.zeros(len(names)), np.zeros(shapes.shape[1]), first[0], gaps]
    nw, ns = len(names), shapes.shape[1]
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = 1 / np.maximum(count[grade], 1)
    weight *= rows / weight.sum() if rows else 1
    for step in range(steps if len(np.unique(grade)) > 1 else 0):
        t = p[nw + ns] + np.r_[0, np.cumsum(np.exp(p[nw + ns + 1 :]))]
        score = np.bincount(row, x * p[col], minlength=rows) + shapes @ p[nw : nw + ns]
        tail = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -50, 50)))
        edge = np.c_[np.ones(rows), tail, np.zeros(rows)]
        at = np.arange(rows)
        prob = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-9)
        slope = np.c_[np.zeros(rows), tail * (1 - tail), np.zeros(rows)]
        up, down = slope[at, grade], slope[at, grade + 1]
        g_score = -weight * (up - down) / prob / rows
        g_t = np.zeros(grades + 1)
        np.add.at(g_t, grade, weight * up / prob / rows)
        np.add.at(g_t, grade + 1, -weight * down / prob / rows)
        g_t = g_t[1:grades]
        tails = np.cumsum(g_t[::-1])[::-1]
        g = np.r_[np.bincount(col, x * g_score[row], minlength=nw) + decay * p[:nw], shapes.T @ g_score + decay * p[nw : nw + ns], tails[0], tails[1:] * np.exp(p[nw + ns + 1 :])]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
    words = np.zeros(buckets, np.float32)
    words[names] = p[:nw]
    return Ordinal(words, p[nw : nw + ns].astype(np.float32), p[nw + ns] + np.r_[0, np.cumsum(np.exp(p[nw + ns + 1 :]))])


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 10_000, buckets: int = 1 << 16) -> Ordinal:
    """Fit on about ``max_rows`` rated documents, chosen by a hash of their ids (all, if there are fewer).

    ``grade`` gives a rating's grade, 0 to grades - 1; ratings without id or grade are left out; of several ratings of a
    document the lowest counts. At most about ``max_rows`` ids are broadcast, and as many rows of features sent back.
    """
    rated = ratings.select(F.col(id_col).alias("rated_id"), grade.cast("int").alias("grade")).where("rated_id IS NOT NULL AND grade IS NOT NULL")
    n = rated.count()
    share = min(1.0, max_rows / max(n, 1))
    picked = rated.where(F.pmod(F.xxhash64(F.lit("quality"), "rated_id"), F.lit(1 << 20)) < int(share * (1 << 20))).groupBy("rated_id").agg(F.min("grade").alias("grade"))
    texts = small_batches(docs).select(F.col(id_col).alias("rated_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "rated_id").select("grade", "text")
    got = texts.mapInArrow(_examples(buckets), "grade int, buckets binary, counts binary, shapes binary").toPandas()
    bucket = np.frombuffer(b"".join(got["buckets"]), np.int32).astype(np.int64)
    value = 1 + np.log(np.maximum(1, np.frombuffer(b"".join(got["counts"]), np.int32)))
    length = got["buckets"].map(len).to_numpy(np.int64) // 4
    shapes = np.frombuffer(b"".join(got["shapes"]), np.float32).reshape(-1, SHAPES).astype(np.float64)
    return fit_ordinal(bucket, value, length, shapes, got["grade"].to_numpy(np.int64), grades, buckets)


def _score(model: Ordinal):
    buckets, grades = len(model.words), len(model.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for at, to, data, off in string_blocks(batch.column(1)):
                row, bucket, count, shapes = _features(data, off, buckets)
                score[at:to] = np.bincount(row, (1 + np.log(count)) * model.words[bucket], minlength=to - at) + shapes @ model.shapes
            tails = model.tails(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(tails.sum(1)), pa.array(tails[:, grades - 1])], ["row_id", "score", "expected_grade", "tail_prob"])

    return run


def grade_documents(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, expected_grade, tail_prob (of the highest grade).

    Defined cases: null and empty texts have no features but the empty shape, so they get the score 0; null ids and
    repeated rows are graded one by one; an empty table gives no rows; other columns of the input are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = small_batches(docs).select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).mapInArrow(_score(model), f"row_id {kind}, score double, expected_grade double, tail_prob double")
    return out.withColumnRenamed("row_id", id_col)
