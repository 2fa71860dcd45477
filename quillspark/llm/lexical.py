"""Ranked lexical search, score at a time over impact-ordered postings.

A first scan keeps, of every document, how often it holds each term of the stated queries, and gives the corpus's counts. A
block of documents is then an inverted index of its own: the postings of each term are grouped by their exact impact (the
share of the score that a document's term brings) and lie by falling impact. A query takes the groups of all its terms from
the highest impact down and adds them to its documents' sums. What the next groups of its lists could still add bounds what
any document may yet gain; once that proves that all but a few candidates stay below the k-th score, it stops, and the
candidates' scores are completed. Scores so far, of a block, of a task, and of a drawn part of the corpus, raise the bar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import run_hashes, saved, small_batches, string_blocks, tokens

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
IMPACT_BITS = 40  # an impact is at most 1000 * ln(2 N + 2) * 10 ** 6
BAND = 0.6  # each step down takes the groups with at least this part of the impact before


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def term_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of its terms, number of terms of each row) of each block of texts."""
    for at, _, data, off in string_blocks(column):
        gap = GAP[data]
        s, e, counts = tokens(data, off, gap)
        yield at, run_hashes(data, s, e, gap), counts


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _counted(vocabulary: np.ndarray):
    """(id, n, terms, tfs) of the documents with terms: their number of terms, and which of the vocabulary they hold how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)
        for batch in batches:
            for at, h, counts in term_hashes(batch.column(1)):
                row = np.repeat(np.arange(len(counts)), counts)
                place = np.minimum(np.searchsorted(vocabulary, h), size - 1)
                known = vocabulary[place] == h
                held, tf = np.unique(row[known] * size + place[known], return_counts=True)
                full = np.flatnonzero(counts)
                cut = np.searchsorted(held, np.r_[full * size, len(counts) * size])
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (held % size, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)).take(pa.array(full)), pa.array(counts[full].astype(np.int64)), *lists], ["id", "n", "terms", "tfs"])

    return run


def _holders(size: int):
    """(term, df): in how many of a task's documents each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    return run


class Block:
    """Postings of some documents, by term and falling impact."""

    def __init__(self, n: np.ndarray, cut: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        m = 50 + (50 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(n)), np.diff(cut))
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
        self.size, self.cut, self.terms, self.gain = len(n), cut, terms, impact  # by document
        key = terms << IMPACT_BITS | ((1 << IMPACT_BITS) - 1 - impact)
        order = np.argsort(key, kind="stable")
        self.key, self.doc, self.impact = key[order], doc[order], impact[order]  # by term and impact

    def _down_to(self, own: np.ndarray, impact: int) -> np.ndarray:
        """Where each list's postings of at least this impact end: at the end of a group of equal ones."""
        return np.searchsorted(self.key, own << IMPACT_BITS | ((1 << IMPACT_BITS) - 1 - impact), "right")

    def search(self, own: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that may be among the best ``k``: no other has ``bar`` or the k-th score here."""
        at = np.searchsorted(self.key, own << IMPACT_BITS)
        end = np.searchsorted(self.key, (own + 1) << IMPACT_BITS)
        live = at < end
        own, at, end = own[live], at[live], end[live]
        sums, none = np.zeros(self.size, np.int64), (np.zeros(0, np.int64),) * 2
        if not len(own):
            return none
        heads = self.impact[at]
        if heads.sum() < bar:
            return none
        level = int(heads.max())
        while True:
            to = np.maximum(at, self._down_to(own, level))
            size = to - at
            spots = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
            np.add.at(sums, self.doc[spots], self.impact[spots])
            at = to
            open_ = at < end
            heads = self.impact[np.minimum(at, len(self.impact) - 1)] * open_
            rest = int(heads.sum())  # no document gains more: it stands once in a list at most
            best = max(bar, int(np.partition(sums, self.size - k)[self.size - k]) if self.size >= k else 0, 1)
            if rest < best:  # no document that was not met can reach the bar
                found = np.flatnonzero(sums + rest >= best)
                if not rest or (self.cut[found + 1] - self.cut[found]).sum() <= (end - at).sum():
                    break  # to complete these reads no more than what is left of the lists
            level = min(int(level * BAND), int(heads.max()))
        if rest:
            mark = np.zeros(int(own.max()) + 1, bool)
            mark[own] = True
            size = self.cut[found + 1] - self.cut[found]
            spots = np.repeat(self.cut[found] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            terms = self.terms[spots]
            hit = (terms <= own.max()) & mark[np.minimum(terms, own.max())]
            score = np.zeros(len(found), np.int64)
            np.add.at(score, np.repeat(np.arange(len(found)), size)[hit], self.gain[spots[hit]])
        else:
            score = sums[found]
        reach = score >= best
        return found[reach], score[reach]


def _ranked(score: np.ndarray, none: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, none, -score))[:k]


def _found(queries: list[np.ndarray], weights: np.ndarray, bars: np.ndarray, k: int, n_docs: int, n_terms: int, docs_per_block: int, postings_per_block: int):
    """(item, id, score): of each query what a task's documents may bring to the best ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bars.copy()
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def searched(parts: list) -> None:
            ids, none, n, size, terms, tfs = (np.concatenate(x) for x in zip(*parts, strict=True))
            block = Block(n, np.r_[0, np.cumsum(size)], terms, tfs, weights, n_docs, n_terms)
            for q, wanted in enumerate(queries):
                doc, score = block.search(wanted, k, int(own[q]))
                if not len(doc):
                    continue
                score, no, at = score, none[doc], ids[doc]
                if q in held:
                    score, no, at = (np.r_[a, b] for a, b in zip(held[q], (score, no, at), strict=True))
                best = _ranked(score, no, at, k)
                held[q] = score[best], no[best], at[best]
                if len(best) == k:
                    own[q] = max(own[q], held[q][0][-1])

        parts, docs, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, docs_per_block):
                part = batch.slice(at, docs_per_block)
                ids = part.column(0)
                size = np.diff(part.column(2).offsets.to_numpy())
                terms, tfs = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                parts.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), part.column(1).to_numpy(), size, terms, tfs))
                docs, postings = docs + part.num_rows, postings + len(terms)
                if docs >= docs_per_block or postings >= postings_per_block:
                    searched(parts)
                    parts, docs, postings = [], 0, 0
        if parts:
            searched(parts)
        for q, (score, none, ids) in held.items():
            reach = score >= own[q]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(reach.sum()), q, np.int32)), pa.array(ids[reach], pa.int64(), mask=none[reach]), pa.array(score[reach])], ["item", "id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _query_blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple]]:
    """The queries with terms, in blocks of about ``most`` terms."""
    block, size = [], 0
    listed = items.select(F.col(id_col).alias("id"), F.array_distinct(terms_of(F.col(text_col))).alias("terms")).where(F.size("terms") > 0).distinct()
    for r in listed.toLocalIterator():
        block.append((r["id"], r["terms"]))
        size += len(r["terms"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 50, terms_at_once: int = 500_000, docs_per_block: int = 4096, postings_per_block: int = 2_000_000, drawn: int = 5_000) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 of each item: item_col, rank, id_col, score (long).

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z as a-z. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 50 + 50 n N div L, its score the sum over an item's terms, once each,
    of weight * (10^9 tf div (1000 tf + 20 m)); N, L and df count every document, div rounds down.
    ``terms_at_once``: queries are taken in blocks of about so many terms, each a pass over the corpus; ``drawn``: about so many
    documents, and a thousandth of all, are searched first for a bar that the k-th score cannot be under - all are searched then.
    Terms are named by 64 bits: among 10^9 different terms of the corpus, the chance that one is taken for a term of 10^5 queried ones is
    about 1 in 200,000.
    Defined cases: null and empty texts, and texts of other characters alone, have no terms: as documents they do not count, as
    items they give no rows; null ids rank after others of an equal score; rows that repeat an id are documents of their own;
    items that agree in id and terms are one; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    item_type = items.schema[item_col].dataType
    out = None
    for block in _query_blocks(items, item_col, item_text, terms_at_once):
        words = sorted({t for _, terms in block for t in terms})
        hashes = np.concatenate([h for _, h, _ in term_hashes(pa.array(words))])
        vocabulary = np.unique(hashes)
        place = dict(zip(words, np.searchsorted(vocabulary, hashes).tolist(), strict=True))
        queries = [np.array(sorted({place[t] for t in terms}), np.int64) for _, terms in block]
        postings = saved(texts.mapInArrow(_counted(vocabulary), "id long, n long, terms array<int>, tfs array<int>"), "postings")
        n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for r in postings.select("terms").mapInArrow(_holders(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            df[r["term"]] = r["df"]
        weights = np.array([weight(n_docs, x) for x in df.tolist()], np.int64)
        shape = (k, n_docs, n_terms, docs_per_block, postings_per_block)
        bars = np.ones(len(queries), np.int64)
        hits = "item int, id long, score long"
        part = postings.sample(min(1.0, drawn / n_docs + 0.001), 7)
        for r in _best(part.mapInArrow(_found(queries, weights, bars.copy(), *shape), hits), k).where(F.col("rank") == k).toLocalIterator():
            bars[r["item"]] = r["score"]
        found = _best(postings.mapInArrow(_found(queries, weights, bars, *shape), hits), k)
        named = spark.createDataFrame(pa.table({"item": pa.array(range(len(block)), pa.int32()), "name": pa.array([x for x, _ in block])}) if block else None)
        some = found.join(named, "item").select(F.col("name").cast(item_type).alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = some if out is None else out.unionByName(saved(some, "ranked"))
    if out is None:
        return items.select(F.col(item_col)).limit(0).withColumns({"rank": F.lit(0).cast("int"), id_col: F.lit(0).cast("long"), "score": F.lit(0).cast("long")})
    return out


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
u AS (SELECT d, doc_id, len(terms) AS n, unnest(terms) AS term FROM t WHERE len(terms) > 0),
c AS (SELECT count(*) AS N_docs, CAST(sum(len(terms)) AS BIGINT) AS L FROM t WHERE len(terms) > 0),
p AS (SELECT d, doc_id, n, term, count(*) AS tf FROM u GROUP BY d, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * N_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term, N_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT q.item_id, p.d, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * c.N_docs) // c.L)))) AS BIGINT) AS score
    FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY q.item_id, p.d, p.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50
"""
