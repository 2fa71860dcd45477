"""Substring dedup by line hashing.

Units are the lines of a text, its paragraphs, or its sentences (pieces of lines that end with ``.``, ``!`` or ``?`` and white
space, so that passages set in other lines are found), normalised to their words with A-Z as a-z. Digests of all units are
grouped globally; of each group the earliest occurrence - smallest id, then position - stays and the others are removed,
with their offsets in the original text kept. Each task merges its own occurrences first, so a digest's owner reads one row a
task; decisions go back by digest, and a digest of more than ``rows_per_salt`` occurrences is salted on the way back, so a line
that a third of all documents hold is no task's burden.

Units of several texts that follow each other form a *run*; a short one that many texts use by chance stands alone, a
repeated passage is a long run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ODD, mix, run_hashes, saved, small_batches, string_blocks, tokens, WHITE, powers

UNITS = "row_id {id}, text_key long, row long, unit int, nth int, start int, end int, n_words int, in_row int, d1 long, d2 long"
HOT_DIGESTS = 1_000_000
STOP = np.zeros(256, bool)
STOP[[ord(x) for x in ".!?"]] = True


def _gaps(data: np.ndarray, off: np.ndarray, kind: str) -> np.ndarray:
    """The bytes between units: \\n, two or more of them, or \\n and the white space of a line that follows a stop."""
    cut = data == 10
    if kind == "paragraph":
        return cut & (np.r_[cut[1:], False] | np.r_[False, cut[:-1]])
    if kind == "sentence" and len(data):
        blank, texts = WHITE[data] & ~cut, off[:-1][off[:-1] < len(data)]
        first = blank & ~np.r_[False, blank[:-1]]
        after_stop = first & np.r_[False, STOP[data[:-1]]]
        first[texts], after_stop[texts] = blank[texts], False  # no text goes on from the one before
        at = np.maximum.accumulate(np.where(first, np.arange(len(data)), 0))
        return cut | (blank & after_stop[at])
    return cut


def _split(min_words: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get(), 0
        for batch in batches:
            for at, to, data, off in string_blocks(batch.column(2)):
                s, e, count = tokens(data, off, _gaps(data, off, kind))
                row = np.repeat(np.arange(to - at), count)
                ws, we, _ = tokens(data, off, WHITE[data])
                words = run_hashes(data, ws, we)
                first = np.searchsorted(ws, s)
                n = np.searchsorted(ws, e) - first
                unit = np.arange(len(s)) - np.searchsorted(row, row)
                keep = n >= max(1, min_words)
                s, e, row, first, n, unit = s[keep], e[keep], row[keep], first[keep], n[keep], unit[keep]
                base = seen + np.int64(task.partitionId() << 40)
                seen += to - at
                if not len(s):
                    continue
                point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte
                start = point[off[row]]
                digest = []
                with np.errstate(over="ignore"):
                    total = np.cumsum(n)
                    nth_word = np.arange(total[-1]) - np.repeat(total - n, n)
                    of = words[np.repeat(first, n) + nth_word]
                    for k in (0, 3):
                        h = np.add.reduceat(mix(of * np.uint64(ODD[k])) * powers(int(n.max()))[nth_word], total - n)
                        digest.append(mix(h + n.astype(np.uint64)).astype(np.int64))
                nth = np.arange(len(s)) - np.searchsorted(row, row)
                order = np.lexsort((*digest, row))
                new = np.flatnonzero(np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in (row, *digest)], axis=0)])
                in_row = np.empty(len(s), np.int64)
                in_row[order] = np.repeat(np.diff(np.r_[new, len(s)]), np.diff(np.r_[new, len(s)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at).take(pa.array(row)), batch.column(1).slice(at, to - at).take(pa.array(row)), pa.array(base + row), *(pa.array(x.astype(np.int32)) for x in (unit, nth, point[s] - start, point[e] - start, n, in_row)), *(pa.array(x) for x in digest)],
                    ["row_id", "text_key", "row", "unit", "nth", "start", "end", "n_words", "in_row", "d1", "d2"],
                )

    return run


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, kind: str = "line", run_words: int = 0, runs: bool = False, occurrences: bool = False, text_keys: bool = False, rows_per_salt: int = 1_000_000) -> DataFrame:
    """One row per removed unit: id, unit, start, end (code points of the original text, end exclusive), n_words,
    keep_id and keep_unit (the occurrence that stays), n_occurrences.

    ``kind`` is line, paragraph or sentence. Units of under ``min_words`` words are never removed, and do not part a run.
    ``runs``: with a column run_words, the words of the run of repeated units that a unit stands in.
    ``run_words``: only units in runs of at least so many words are given; units that repeat in one row alone make no run.
    ``occurrences``: the occurrences that stay are given too, with removed as a column.
    ``text_keys``: with a column text_key, by which ``without_units`` tells apart texts that share an id.
    Units are numbered from 0 among a text's non-empty ones.
    Defined cases: null and empty texts have no units; a null id ranks after all others; rows that repeat an id and text
    hold the same units at the same rank, and the first rank's occurrences of one unit all stay; a line repeated inside
    one text stays once; an empty table gives no rows; other columns of the input are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    key = text_key(id_col, text_col) if text_keys else F.lit(None).cast("long")
    texts = small_batches(docs).select(F.col(id_col).alias("row_id"), key.alias("text_key"), F.col(text_col).alias("text"))
    units = saved(texts.mapInArrow(_split(min_words, kind), UNITS.format(id=id_type)), "units")
    # so many occurrences make a digest hot; there are HOT_DIGESTS such digests at most
    hot_from = max(rows_per_salt, -(-units.count() // HOT_DIGESTS))
    rank = F.struct(F.col("row_id").isNull().alias("none"), "row_id", "unit")
    merged = units.groupBy("d1", "d2").agg(F.min(rank).alias("r"), F.count("*").alias("n_occurrences"), F.max("in_row").alias("in_row")).where("n_occurrences > 1")
    merged = merged.where("in_row < n_occurrences") if run_words else merged  # a run stands in several rows
    salts = F.ceil(F.col("n_occurrences") / hot_from).cast("int")
    kept = saved(merged.select("d1", "d2", F.col("r.row_id").alias("keep_id"), F.col("r.unit").alias("keep_unit"), "n_occurrences", salts.alias("salts")), "repeated")
    hot = F.broadcast(kept.where("salts > 1").select("d1", "d2", "salts"))
    units = units.join(hot, ["d1", "d2"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row", "unit"), "salts").cast("int"), F.lit(0))).drop("salts", "in_row")
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    out = units.join(kept, ["d1", "d2", "salt"])
    more = []
    if runs or run_words:
        in_text = Window.partitionBy("row")
        out = out.withColumn("run", F.col("nth") - F.row_number().over(in_text.orderBy("nth")))
        out = out.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("row", "run")).cast("int"))
        out = out.where(F.col("run_words") >= run_words) if run_words else out
        more.append("run_words")
    stays = F.col("row_id").eqNullSafe(F.col("keep_id")) & (F.col("unit") == F.col("keep_unit"))
    if occurrences:
        out = out.withColumn("removed", ~stays)
        more.append("removed")
    else:
        out = out.where(~stays)
    return out.select(F.col("row_id").alias(id_col), "unit", "start", "end", "n_words", F.col("keep_id").alias(f"keep_{id_col}"), "keep_unit", "n_occurrences", *more, *["text_key"] * text_keys)


def text_key(id_col: str, text_col: str) -> Column:
    """Names a text under its id; rows of one name have the same spans."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(id_col).isNull())


def without_units(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the removed spans cut out of their texts; every other column is kept as it is.

    ``removed`` needs id_col, start and end, and text_key where an id may name several texts, or be null: without it the
    spans of an id are cut out of each of its rows.
    Defined cases: null texts stay null; spans that are given twice count once; rows that repeat an id and text are cut alike;
    documents without spans, and an empty ``removed``, change nothing; columns may have any names.
    """
    by_text = "text_key" in removed.columns
    spans = removed.groupBy(F.col(id_col).alias("id"), *["text_key"] * by_text).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("doc")
    joined = docs.select(F.col(id_col).alias("own"), text_key(id_col, text_col).alias("own_key"), row).join(spans, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key") if by_text else F.lit(True)), "left")
    text = F.col("doc").getField(text_col)
    # what stays lies between the end of one span and the start of the next
    from_, to = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["end"])), F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.length(text)))
    rest = F.array_join(F.transform(F.arrays_zip(from_.alias("a"), to.alias("b")), lambda x: F.substring(text, x["a"] + 1, x["b"] - x["a"])), "")
    cut = F.when(F.col("spans").isNull(), text).otherwise(rest)
    return joined.select(*(cut.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))


#: Every repeated line but the earliest, with the words of its run of repeated lines.
LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - len(line) - 1 AS s FROM l),
u AS (SELECT doc_id, s, len(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit,
    array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS t,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM m WHERE line <> ''),
r AS (SELECT *, first_value(doc_id) OVER o AS kd, first_value(unit) OVER o AS ku, count(*) OVER (PARTITION BY t) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS nth
    FROM u WHERE w >= 1 WINDOW o AS (PARTITION BY t ORDER BY doc_id, unit)),
g AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM r WHERE c > 1),
q AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, run) AS rw FROM g)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(s AS INTEGER) AS start, CAST(s + n AS INTEGER) AS "end", CAST(w AS INTEGER) AS n_words,
    kd AS keep_doc_id, CAST(ku AS INTEGER) AS keep_unit, CAST(c AS BIGINT) AS n_occurrences, CAST(rw AS INTEGER) AS run_words
FROM q WHERE doc_id <> kd OR unit <> ku
"""
#: Sentences of any length in runs of 30 words or more that several texts hold; the earliest of each is told, and stays.
SENTENCES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, i, string_split(regexp_replace(line, '([.!?])([\x20\x09-\x0D]+)', '\1\2' || chr(57344), 'g'), chr(57344)) AS held, line,
    sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - len(line) - 1 AS line_at FROM l),
p AS (SELECT doc_id, i, line_at, unnest(held) AS piece, generate_subscripts(held, 1) AS j FROM m),
u AS (SELECT doc_id, line_at + sum(len(piece)) OVER (PARTITION BY doc_id, i ORDER BY j) - len(piece) AS s, len(regexp_replace(piece, '([.!?])[\x20\x09-\x0D]+$', '\1')) AS n,
    row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS unit,
    array_to_string(regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS t,
    len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS w FROM p WHERE piece <> ''),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY t) <> max(doc_id) OVER (PARTITION BY t) AS apart, first_value(doc_id) OVER o AS kd, first_value(unit) OVER o AS ku, count(*) OVER (PARTITION BY t) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS nth
    FROM u WHERE w >= 1 WINDOW o AS (PARTITION BY t ORDER BY doc_id, unit)),
g AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM r WHERE apart),
q AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, run) AS rw FROM g)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(s AS INTEGER) AS start, CAST(s + n AS INTEGER) AS "end", CAST(w AS INTEGER) AS n_words,
    kd AS keep_doc_id, CAST(ku AS INTEGER) AS keep_unit, CAST(c AS BIGINT) AS n_occurrences, CAST(rw AS INTEGER) AS run_words, doc_id <> kd OR unit <> ku AS removed
FROM q WHERE rw >= 30
"""
ORACLE = f"SELECT 'line' AS kind, *, true AS removed FROM ({LINES}) UNION ALL SELECT 'sentence', * FROM ({SENTENCES})"
