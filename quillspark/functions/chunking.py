"""Structure-aware chunks as folds over arrays: paragraphs are packed up to a size, tables stay whole, long paragraphs are
packed by sentence, and a sentence longer than the size is sliced. The sentence splitter is a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


def sentences(text: Column) -> Column:
    """Stand-in for a language-aware splitter: up to and with a mark of sentence end, or a line."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def is_table(text: Column) -> Column:
    """A markdown table: a row of cells, then a row of dashes, colons and blanks, each cell with a dash."""
    rows = F.filter(F.transform(F.split(text, r"\R"), strip), lambda l: l != "")
    head, rule = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    cells = F.split(F.regexp_replace(rule, r"^\||\|$", ""), r"\|", -1)
    framed = lambda l: l.startswith("|") & l.endswith("|")
    ok = framed(head) & framed(rule) & F.forall(cells, lambda c: strip(c).rlike(r"^[-: ]*-[-: ]*$"))
    return (F.size(rows) >= 2) & F.coalesce(ok, F.lit(False))


def _state(done: Column, cur: Column) -> Column:
    return F.struct(done.alias("done"), cur.alias("cur"))


def _flush(acc: Column) -> Column:
    return F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))


def _pack(items: Column, size: int, joiner: str) -> Column:
    """Greedy packing of (text, fixed) elements: fixed ones stand alone, others are joined while they fit."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["cur"] != "") & (F.length(acc["cur"]) + len(joiner) + F.length(x["text"]) <= size)
        alone = _state(F.concat(_flush(acc), F.array(x["text"])), F.lit(""))
        more = _state(acc["done"], F.concat(acc["cur"], F.lit(joiner), x["text"]))
        return F.when(x["fixed"], alone).when(fits, more).otherwise(_state(_flush(acc), x["text"]))

    return F.aggregate(items, _state(empty, F.lit("")), step, _flush)


def _element(text: Column, fixed: Column | bool) -> Column:
    return F.struct(text.alias("text"), (fixed if isinstance(fixed, Column) else F.lit(fixed)).alias("fixed"))


def long_paragraph(text: Column, size: int, splitter: Callable[[Column], Column] = sentences) -> Column:
    slices = lambda s: F.transform(F.sequence(F.lit(0), F.length(s) - 1, F.lit(size)), lambda i: _element(F.substr(s, i + 1, F.lit(size)), True))
    parts = F.flatten(F.transform(splitter(text), lambda s: F.when(F.length(s) > size, slices(s)).otherwise(F.array(_element(s, False)))))
    return _pack(parts, size, " ")


def argument_problem(size: Column, overlap: Column) -> Column:
    """What is wrong with a size and an overlap; null for nothing."""
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "size must be positive").when(F.coalesce((overlap < 0) | (overlap >= size), F.lit(True)), "overlap must be between 0 and size - 1")


def chunk(text: Column, size: int = 300, overlap: int = 0, paragraph: str = "\n\n", splitter: Callable[[Column], Column] = sentences) -> Column:
    """The chunks of a text as an array; null and empty texts have none."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap between 0 and size - 1")
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), paragraph), strip), lambda p: p != "")
    whole = lambda p: F.array(_element(p, is_table(p)))
    cut = lambda p: F.transform(long_paragraph(p, size, splitter), lambda c: _element(c, True))
    items = F.flatten(F.transform(paragraphs, lambda p: F.when((F.length(p) > size) & ~is_table(p), cut(p)).otherwise(whole(p))))
    chunks = _pack(items, size, "\n\n")
    return let(chunks, lambda c: overlapped(c, size, overlap, splitter)) if overlap else chunks


def overlapped(chunks: Column, size: int, overlap: int, splitter: Callable[[Column], Column] = sentences) -> Column:
    """Each chunk after the last ``overlap`` sentences of the one before it, as many as fit; tables neither give nor take."""

    def with_tail(c: Column, i: Column) -> Column:
        before = F.get(chunks, i - 1)
        last = F.reverse(F.slice(F.reverse(splitter(before)), F.lit(1), F.lit(overlap)))
        start = F.struct(F.array().cast("array<string>").alias("held"), (F.length(c) + 2).alias("n"), F.lit(False).alias("full"))

        def step(acc: Column, s: Column) -> Column:
            n = acc["n"] + F.length(s) + F.when(F.size(acc["held"]) > 0, 1).otherwise(0)
            stop = F.struct(acc["held"].alias("held"), acc["n"].alias("n"), F.lit(True).alias("full"))
            return F.when(acc["full"] | (n > size), stop).otherwise(F.struct(F.concat(F.array(s), acc["held"]).alias("held"), n.alias("n"), F.lit(False).alias("full")))

        held = F.aggregate(F.reverse(last), start, step, lambda acc: F.array_join(acc["held"], " "))
        skip = (i == 0) | is_table(c) | F.coalesce(is_table(before), F.lit(True))
        return F.when(skip, c).otherwise(F.when(held == "", c).otherwise(F.concat(held, F.lit("\n\n"), c)))

    return F.transform(chunks, with_tail)


def same_chunks(stored: Column, new: Column) -> Column:
    """Whether stored chunks can stay: there are some, and they are the new ones in order. Null counts as none."""
    held, fresh = F.coalesce(stored, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))
    return (F.size(held) > 0) & (held == fresh)
