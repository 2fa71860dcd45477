"""Text cleaning and normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Lines that begin a page's footer; repairs of words that scanning split; symbols that normalisation removes.
FOOTERS = (r"^등록번호\s*:", r"^발행일자\s*:", r"^주소\s*:", r"^전화번호\s*:", r"^Copyright\b", r"^연예\s+해외연예\s+스타\s+TV일반")
REPAIRS = (
    (r"유 품", "유품"), (r"엄빌\s+리컬", "엄빌리컬"), (r"판단[ \t]+했다\b", "판단했다"), (r"말[ \t]+했다\b", "말했다"), (r"조성[ \t]+하여\b", "조성하여"),
    (r"평가[ \t]+받았다\b", "평가받았다"), (r"개설·[ \t]+운영함으로써\b", "개설·운영함으로써"), (r"감소[ \t]+했다\b", "감소했다"), (r"\bPr[ \t]+e\b", "Pre"), (r"([·~])[ \t]+", "$1"),
)
MOMENT = r"\d{4}[-./]\d{1,2}[-./]\d{1,2}[ \t]+\d{1,2}:\d{2}(?::\d{2})?"
UNITS = "년|월|일|시|분|초|명|건|개|회|원|만원|억원|조원"
REPORTER = r"\[[^\]\n]+?\s+[가-힣]{2,5}\s+기자\]"
SYMBOLS = "△▲◆"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lines(x: Column) -> Column:
    return F.split(x, r"\R")


def squeeze_lines(x: Column) -> Column:
    return F.array_join(F.transform(lines(x), lambda l: F.regexp_replace(strip(l), r"[ \t]+", " ")), "\n")


def drop_first(x: Column, pattern: str) -> Column:
    """Remove the first match only."""

    def cut(hit: Column) -> Column:
        at = F.position(hit, x)
        return F.when(hit == "", x).otherwise(F.concat(F.substr(x, F.lit(1), at - 1), F.substr(x, at + F.length(hit))))

    return let(F.regexp_extract(x, pattern, 0), cut)


def cut_footer(x: Column) -> Column:
    parts = lines(x)
    first = F.array_position(F.transform(parts, lambda l: strip(l).rlike("|".join(FOOTERS))), True)
    return F.when(first == 0, x).otherwise(F.array_join(F.slice(parts, F.lit(1), (first - 1).cast("int")), "\n"))


def join_digits(x: Column) -> Column:
    """Blanks between digits go, except inside a date with a time: pieces between such moments are cleaned on their own."""
    inner = lambda p: F.regexp_replace(p, r"(?<=\d)[ \t]+(?=\d)", "")
    moments = F.regexp_extract_all(x, F.lit(MOMENT), F.lit(0))
    glued = F.zip_with(F.split(x, MOMENT, -1), moments, lambda a, b: F.concat(inner(a), F.coalesce(b, F.lit(""))))
    return F.array_join(glued, "")


def clean(x: Column) -> Column:
    """The whole chain; null is the empty text."""
    x = let(squeeze_lines(F.coalesce(x, F.lit(""))), lambda t: drop_first(t, REPORTER))
    x = let(let(x, cut_footer), join_digits)
    # most texts hold nothing to repair: one plain test spares them ten passes
    x = let(x, lambda t: F.when(t.rlike(rf"[ \t](?:{UNITS})"), F.regexp_replace(t, rf"(?U)(?<=\d)[ \t]+(?=(?:{UNITS})\b)", "")).otherwise(t))
    x = let(x, lambda t: F.when(t.rlike("[가-힣·~]|Pr[ \t]"), repaired(t)).otherwise(t))
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def repaired(x: Column) -> Column:
    for pattern, new in REPAIRS:
        x = F.regexp_replace(x, "(?U)" + pattern, new)
    return x


def normalize(x: Column, symbols: str = SYMBOLS) -> Column:
    """Symbols go, full-width forms become ASCII, runs of white space one newline (if they hold one) or one blank."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    x = F.translate(x, wide + symbols, narrow)
    x = F.regexp_replace(x, r"(?U)\s*[\r\n]\s*", "\n")
    return strip(F.regexp_replace(x, r"(?U)[\s&&[^\n]]+", " "))


def problems(x: Column, symbols: str = SYMBOLS) -> Column:
    """What normalisation would still change, as a list of names."""
    any_of = lambda *xs: F.exists(F.array(*[F.lit(y) for y in xs]), lambda y: F.contains(x, y))
    tests = (("제거 대상 기호", x.rlike(f"[{symbols}]")), ("전각 문자", x.rlike(r"[！-～]")), ("연속 공백/줄바꿈", any_of("  ", "\n\n", " \n", "\n ", "\r", "\t")), ("앞뒤 공백", x != strip(x)))
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))


def content_hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def title(found: Column, filename: Column) -> Column:
    """The document's title or the file's stem, 255 characters at most; null if nothing is left."""
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")
    return F.nullif(F.left(strip(F.coalesce(F.nullif(found, F.lit("")), stem)), F.lit(255)), F.lit(""))


def contains_literal(x: Column, part: str) -> Column:
    """LIKE with the wildcards of ``part`` escaped is plain containment."""
    return F.contains(x, F.lit(part))


def mark(context: Column, start: Column, length: Column, around: int = 150, head: int = 300) -> Column:
    """A preview with [[ ]] about the answer, or the first characters if there is none."""
    lo = F.greatest(start - around, F.lit(0))
    end = start + length
    cut = F.concat(F.when(lo > 0, "...").otherwise(""), F.substr(context, lo + 1, start - lo), F.lit("[["), F.substr(context, start + 1, length), F.lit("]]"), F.substr(context, end + 1, F.lit(around)), F.when(end + around < F.length(context), "...").otherwise(""))
    return F.when(start.isNull(), F.left(context, F.lit(head))).otherwise(cut)


def file_size(size: Column) -> Column:
    """Bytes as KB with one decimal."""
    return F.concat(F.format_string("%.1f", size / F.lit(1024.0)), F.lit(" KB"))


def shown_date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("정보 없음"))


def initial(name: Column) -> Column:
    return F.upper(F.left(strip(name), F.lit(1)))


def org_code(length: int = 10) -> Column:
    """A random code of A-Z and 0-9, another for every row and run."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    return F.concat(*[F.substr(letters, F.floor(F.rand() * 36).cast("int") + 1, F.lit(1)) for _ in range(length)])


#: White space as Unicode has it (``(?U)\\s``).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _places(symbols: str):
    is_space = np.zeros(0x3002, bool)  # the last one: whatever lies beyond
    is_space[[ord(c) for c in SPACES]] = True

    def told(texts: pa.Array) -> pa.Array:
        held = pc.fill_null(texts, "").to_pylist()
        c = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
        n = np.fromiter(map(len, held), np.int64, len(held))
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
        kept = np.ones(len(c), bool)
        for x in symbols:
            kept &= c != ord(x)
        row, place, space = row[kept], place[kept], is_space[np.minimum(c[kept], 0x3001)]
        first = np.r_[True, row[1:] != row[:-1]][: len(row)]
        begins = ~space | ~(first | np.r_[False, space[:-1]][: len(row)])  # none where a text begins
        row, place, space = row[begins], place[begins], space[begins]
        last = np.r_[row[1:] != row[:-1], True][: len(row)]
        row, place = row[~(space & last)], place[~(space & last)]
        ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(n)))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()), mask=pc.is_null(texts))

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([told(texts.slice(i, 200)) for i in range(0, max(1, len(texts)), 200)])

    return run


def normal_map(x: Column, symbols: str = SYMBOLS) -> Column:
    """Of each character of ``normalize(x)``, its place in ``x``: a run of white space stands where it begins.

    Whole texts go to Python in Arrow batches: functions of arrays take each character by itself. Told not to be deterministic, so that
    filters on the places do not run it again."""
    if (spark := SparkSession.getActiveSession()) is not None and int(spark.conf.get(_BATCH)) not in range(1, 2001):
        spark.conf.set(_BATCH, "2000")  # places are four bytes a character
    return F.arrow_udf(_places(symbols), "array<int>").asNondeterministic()(x)


def normal_start(places: Column, start: Column) -> Column:
    """Where the normalised text has the first character that stood at ``start`` or later; null if there is none."""
    return F.nullif(F.size(F.filter(places, lambda p: p < start)), F.size(places))


def admin_code() -> Column:
    """A random code of 12 hexadecimal digits, another for every row and run."""
    return F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(12))
