"""Models that a corpus teaches in one pass each: where sentences end, where words part, and what weighs in a vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# ---------------------------------------------------------------- sentences

#: A sentence: up to marks of its end, with what closes after them, before white space or the end of the line.
PIECE = r"""[^\n]+?(?:[.!?…]+["'”’)\]]*(?=\s|$)|$)"""
WORD = r"[^ \t\n\x0B\f\r]+"


def abbreviation_scores(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n_dot, n_bare, score): how much better ``word`` and a period fit together than by chance.

    The log-likelihood ratio of P(period | word) = 0.99 against the period's share in all words, less for long words, for occurrences
    without a period (one over the length to their power), more for inner periods. Words are of letters and inner periods, without case.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))).alias("w"))
    words = words.select(F.regexp_replace("w", r"\.$", "").alias("word"), F.col("w").endswith(".").alias("dot")).where(F.col("word").rlike(r"^\p{L}[\p{L}.]*$"))
    counts = words.groupBy("word").agg(F.count_if("dot").alias("n_dot"), F.count_if(~F.col("dot")).alias("n_bare"))
    total = counts.agg(F.sum("n_dot").alias("dots"), F.sum(F.col("n_dot") + F.col("n_bare")).alias("all"))  # one row
    held = counts.where("n_dot > 0").crossJoin(F.broadcast(total))
    p, letters = F.col("dots") / F.col("all"), F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    chance = F.col("n_dot") * F.ln(p) + F.col("n_bare") * F.ln(F.greatest(1 - p, F.lit(1e-12)))
    bound_ = F.col("n_dot") * F.ln(F.lit(0.99)) + F.col("n_bare") * F.ln(F.lit(0.01))
    inner = F.length("word") - letters + 1
    score = 2 * (bound_ - chance) * F.exp(-letters) * inner * F.pow(letters, -F.least(F.col("n_bare"), F.lit(300)))
    return held.select("word", "n_dot", "n_bare", score.alias("score"))


def starter_scores(texts: DataFrame, abbreviations: list[str], text: str = "text") -> DataFrame:
    """(word, n_first, n_all, score): how much more often ``word`` begins a sentence than by chance (log-likelihood ratio; 0 if less often).
    Sure sentence ends are marks other than periods, and periods after a word that is no abbreviation."""
    held = texts.select(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)).alias("w"))
    ends = lambda w: w.rlike(r"""[!?…]["'”’)\]]*$""") | (w.endswith(".") & ~F.lower(F.regexp_replace(w, r"\.$", "")).isin(*(abbreviations or [""])))
    pairs = held.select(F.explode(F.transform("w", lambda w, i: F.struct(F.regexp_extract(F.lower(w), r"^[^\p{L}]*(\p{L}+)", 1).alias("word"), F.coalesce(ends(F.get("w", i - 1)), F.lit(False)).alias("first")))).alias("x")).select("x.*")
    n = pairs.groupBy("word").agg(F.count_if("first").alias("n_first"), F.count("*").alias("n_all"))
    total = n.agg(F.sum("n_first").alias("ends"), F.sum("n_all").alias("words"))
    a, b, ab, m = (F.col(c).cast("double") for c in ("ends", "n_all", "n_first", "words"))
    safe = lambda q: F.greatest(F.least(q, F.lit(1 - 1e-12)), F.lit(1e-12))
    fit = lambda k, of, q: k * F.ln(safe(q)) + (of - k) * F.ln(1 - safe(q))
    score = -2 * (fit(ab, a, b / m) + fit(b - ab, m - a, b / m) - fit(ab, a, ab / a) - fit(b - ab, m - a, (b - ab) / F.greatest(m - a, F.lit(1.0))))
    kept = n.where("word <> '' AND n_first > 0").crossJoin(F.broadcast(total))
    return kept.select("word", "n_first", "n_all", F.when(ab / a > b / m, score).otherwise(0.0).alias("score"))


@dataclass(frozen=True)
class SentenceModel:
    abbreviations: tuple[str, ...]
    starters: tuple[str, ...]


def fit_sentences(texts: DataFrame, text: str = "text", abbreviation: float = 0.3, starter: float = 30.0, most: int = 2_000) -> SentenceModel:
    """The words whose scores reach the thresholds; of each kind the ``most`` with the highest scores, which is the model's size."""
    best = lambda df, least: tuple(sorted(r[0] for r in df.where(F.col("score") >= least).orderBy(F.desc("score"), "word").limit(most).collect()))
    short = best(abbreviation_scores(texts, text), abbreviation)
    return SentenceModel(short, best(starter_scores(texts, list(short), text), starter))


def splitter(model: SentenceModel) -> Callable[[Column], Column]:
    """A sentence splitter for ``chunking``: a period after an abbreviation ends a sentence only before a word that often begins one.
    Periods inside words and numbers end none; a line ends every sentence. Null and blank texts have none."""
    short, first = F.lit(list(model.abbreviations) or [""]), F.lit(list(model.starters) or [""])

    def open_(piece: Column) -> Column:
        last = F.lower(F.regexp_extract(piece, r"([\p{L}.]+)\.$", 1))
        return (last != "") & F.array_contains(short, last)

    def joined(pieces: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            word = F.lower(F.regexp_extract(p, r"^[^\p{L}]*(\p{L}+)", 1))
            goes_on = F.coalesce(open_(last) & ~F.array_contains(first, word), F.lit(False))
            more = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), p)))
            return F.when(goes_on, more).otherwise(F.concat(acc, F.array(p)))

        return F.aggregate(pieces, F.array().cast("array<string>"), step)

    def split(text: Column) -> Column:
        lines = F.split(F.coalesce(text, F.lit("")), "\n")
        tidy = lambda line: F.filter(F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), strip), lambda s: s != "")
        return F.flatten(F.transform(lines, lambda line: joined(tidy(line))))

    return split


# ---------------------------------------------------------------- spacing

PAIRS = "a string, b string, n_joined long, n_spaced long"


def _pairs(batches: Iterator[pa.RecordBatch], at_once: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """How often two characters stand next to each other, and how often with one blank between them."""
    for batch in batches:
        text = "\n".join(t for t in batch.column(0).to_pylist() if t)
        for at in range(0, len(text), at_once):
            c = np.frombuffer(text[at : at + at_once + 2].encode("utf-32-le"), np.uint32).astype(np.uint64)
            solid = ~np.isin(c, (32, 9, 10, 11, 12, 13))
            inner = np.arange(len(c)) < at_once  # a pair belongs to where it begins
            near = np.flatnonzero(solid[:-1] & solid[1:] & inner[:-1])
            apart = np.flatnonzero(solid[:-2] & (c[1:-1] == 32) & solid[2:] & inner[:-2])
            key = np.concatenate([c[near] << np.uint64(32) | c[near + 1], c[apart] << np.uint64(32) | c[apart + 2]])
            names, of = np.unique(key, return_inverse=True)
            n = [np.bincount(x, minlength=len(names)) for x in (of[: len(near)], of[len(near) :])]
            said = lambda x: pa.array([chr(i) for i in x.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([said(names >> np.uint64(32)), said(names & np.uint64(0xFFFFFFFF)), pa.array(n[0]), pa.array(n[1])], ["a", "b", "n_joined", "n_spaced"])


def fit_spacing(texts: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """(a, b, n_joined, n_spaced) of all pairs of characters that stand next to each other, or one blank apart, ``least`` times or more."""
    n = texts.select(text).mapInArrow(_pairs, PAIRS).groupBy("a", "b").agg(F.sum("n_joined").alias("n_joined"), F.sum("n_spaced").alias("n_spaced"))
    return n.where(F.col("n_joined") + F.col("n_spaced") >= least)


def glued(df: DataFrame, left: str, right: str, model: DataFrame, name: str, least: int = 5) -> DataFrame:
    """``name``: both texts in one, with a blank between them if the pair of characters where they meet is more often parted than joined.

    A pair that was seen under ``least`` times is decided by what its first character has after it and its second before it; one with unknown
    characters gets a blank. After ``=``, which marks a word that was broken, there is none. Null and empty texts add nothing.
    """
    odds = lambda prefix: F.ln((F.col(f"{prefix}_spaced") + 0.5) / (F.col(f"{prefix}_joined") + 0.5))
    named = lambda of, p: of.withColumnsRenamed({"n_joined": f"{p}_joined", "n_spaced": f"{p}_spaced", "a": f"{p}_a", "b": f"{p}_b"})
    summed = lambda c: model.groupBy(c).agg(F.sum("n_joined").alias("n_joined"), F.sum("n_spaced").alias("n_spaced"))
    own, after, before = named(model.where(F.col("n_joined") + F.col("n_spaced") >= least), "_own"), named(summed("a"), "_after"), named(summed("b"), "_before")
    held = df.withColumns({"_l": F.right(F.coalesce(left, F.lit("")), F.lit(1)), "_r": F.left(F.coalesce(right, F.lit("")), F.lit(1))})
    held = held.join(own, (F.col("_l") == F.col("_own_a")) & (F.col("_r") == F.col("_own_b")), "left").join(after, F.col("_l") == F.col("_after_a"), "left").join(before, F.col("_r") == F.col("_before_b"), "left")
    parted = F.coalesce(odds("_own"), F.coalesce(odds("_after"), F.lit(0.0)) + F.coalesce(odds("_before"), F.lit(0.0)) + 1e-9) > 0
    between = F.when((F.col("_l") == "") | (F.col("_r") == "") | (F.col("_l") == "="), "").when(parted, " ").otherwise("")
    return held.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.concat(F.coalesce(left, F.lit("")), between, F.coalesce(right, F.lit(""))).alias(name))


# ---------------------------------------------------------------- vectors

SLOTS = 1 << 16


@dataclass(frozen=True)
class Embedder:
    """``weights``: of each slot that words are hashed to, the logarithm of how rare it is among the texts."""

    weights: np.ndarray
    size: int

    def signs(self) -> np.ndarray:
        """A fixed direction of +1 and -1 for each slot."""
        return np.random.default_rng(12).integers(0, 2, (len(self.weights), self.size), np.int8) * 2 - 1


def slots(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))


def fit_embedder(texts: DataFrame, text: str = "text", size: int = 64) -> Embedder:
    """One pass over all texts; a number a slot comes to the driver."""
    held = texts.select(F.array_distinct(slots(F.col(text))).alias("s"))
    n = held.select(F.explode(F.concat("s", F.array(F.lit(-1)))).alias("slot")).groupBy("slot").count().collect()
    df = np.zeros(SLOTS, np.int64)
    total = next((r["count"] for r in n if r["slot"] == -1), 0)
    for r in n:
        if r["slot"] >= 0:
            df[r["slot"]] = r["count"]
    return Embedder(np.log((total + 1) / (df + 1)), size)


def _embedded(model: Embedder, words_at_once: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = model.signs().astype(np.float32) * model.weights[:, None].astype(np.float32)
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            slot, cut = held.flatten().to_numpy(), held.offsets.to_numpy()
            slot, cut = slot, cut - cut[0]
            row = np.repeat(np.arange(len(held)), np.diff(cut))
            out = np.zeros((len(held), model.size))
            for at in range(0, len(slot), words_at_once):
                own = row[at : at + words_at_once]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[own[first]] += np.add.reduceat(signs[slot[at : at + words_at_once]], first, axis=0, dtype=np.float64)
            length = np.sqrt((out * out).sum(1, keepdims=True))
            out = (out / np.where(length > 0, length, 1)).astype(np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * model.size), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], [*batch.schema.names[:-1], "embedding"])

    return run


def embedded(df: DataFrame, text: Column, model: Embedder, name: str = "embedding") -> DataFrame:
    """``df`` with the vector of ``text``: of length 1, or 0 for a text without words (null and empty ones too). Equal words in any order have equal
    vectors; what rare words two texts share brings them near, what all texts share hardly does."""
    kept = [c for c in df.columns if c != name]
    plain = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), slots(text).alias("slots"))
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    out = plain.mapInArrow(_embedded(model), f"{kinds}{', ' if kinds else ''}embedding array<float>")
    return out.toDF(*kept, name)
