"""Typed columns out of model output: calls, lists, verdicts, metadata. Nothing raises: unreadable output is null or empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import CATEGORIES, PERIOD_LABELS, category_of, compact, first_match, period_of
from .text import let, lines, strip

#: Words that mark lists, counts and the archive's own data; tools with their allowed and required arguments; the
#: patterns of dates, job titles, domains and list marks. The patterns inside the functions below that name Korean words, call tags
#: or thought tags are fixed values as well: they are what the outputs look like.
LIST_WORDS = ("목록", "리스트", "최근기사", "최근에올라온", "어떤기사")
BY_CATEGORY_WORDS = ("분야별", "카테고리별")
COUNT_WORDS = ("몇개", "몇건", "개수", "건수")
CUE_WORDS = ("기사", "회사", "우리", "조직", "템플릿", "지침", "구성원", "사용자", "기자", "언론사", "신문", *(f"{c}부" for c in CATEGORIES))
TOOLS = {
    "count_articles": (("period", "category"), ()),
    "list_recent_articles": (("period", "category"), ()),
    "count_articles_by_category": (("period",), ()),
    "count_articles_by_author": (("author", "period"), ("author",)),
    "count_articles_by_media": (("media", "period"), ("media",)),
    "list_templates": ((), ()),
    "list_guidelines": ((), ()),
    "count_members": ((), ()),
}
VERDICTS = ("충족", "미흡", "해당 없음", "판정 실패")
ARGUMENTS = "map<string,string>"
DATE = r"(\d{4})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})\s*일?\.?(?:\s*(?:\([월화수목금토일]\))?\s*(오전|오후)?\s*(\d{1,2})\s*[:시]\s*(\d{2})?)?"
JOB = r"(?U)\s*(선임기자|수석기자|객원기자|인턴기자|기자|특파원)$"
DOMAIN = r"(?i)[A-Za-z0-9-]+\.(?:co\.kr|or\.kr|com|net|kr|org)\b"
LIST_MARK = r"(?U)^\s*(?:\d+\s*[.)]|\(\d+\)|[-•·*▪◦]|[①-⑳])\s*"


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def tool_call(raw: Column) -> Column:
    """struct(name, arguments as a map of strings), or null."""
    tagged = F.regexp_extract(raw, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)
    found = F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))
    none = F.parse_json(F.lit("{}"))

    def given(v: Column) -> Column:
        spoken = F.try_variant_get(v, "$.arguments", "string")
        kind = F.schema_of_variant(F.try_variant_get(v, "$.arguments", "variant"))
        return F.when(kind == "STRING", F.when(spoken == "", none).otherwise(F.try_parse_json(spoken))).when(kind.isNull() | (kind == "VOID"), none).otherwise(F.try_variant_get(v, "$.arguments", "variant"))

    def read(v: Column) -> Column:
        named = F.schema_of_variant(F.try_variant_get(v, "$.name", "variant")) == "STRING"
        name = F.when(F.schema_of_variant(v).startswith("OBJECT") & named, F.try_variant_get(v, "$.name", "string"))
        arguments = let(given(v), lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", ARGUMENTS)))
        return let(F.struct(name.alias("name"), arguments.alias("arguments")), lambda c: F.when(c["name"].isNotNull() & c["arguments"].isNotNull(), c))

    return let(F.try_parse_json(found), read)


def checked_call(call: Column, question: Column) -> Column:
    """struct(name, arguments): the call as it may run, repaired where it contradicts the question; null if it may not.

    Every step is bound once (``let``): steps that repeated the ones before them would grow the plan exponentially.
    """
    state = lambda text, name, args: F.struct(text.alias("text"), name.alias("name"), args.alias("args"))
    per_tool = lambda name, i: first_match([(name == t, list(x[i])) for t, x in TOOLS.items() if x[i]], None)
    empty = F.array().cast("array<string>")

    def moved(s: Column) -> Column:
        department = lambda key: F.nullif(F.regexp_extract(strip(F.coalesce(s["args"][key], F.lit(""))), f"^({'|'.join(CATEGORIES)})부$", 1), F.lit(""))
        to = lambda d: F.when(d.isNotNull(), state(s["text"], F.lit("count_articles"), F.create_map(F.lit("period"), F.coalesce(s["args"]["period"], F.lit("all")), F.lit("category"), d))).otherwise(s)
        return let(F.coalesce(department("author"), department("media")), to)

    def renamed(s: Column) -> Column:
        by_category = (s["name"] == "count_articles_by_category") & ~has_any(s["text"], BY_CATEGORY_WORDS)
        listed = (s["name"] == "list_recent_articles") & has_any(s["text"], COUNT_WORDS)
        return state(s["text"], F.when(by_category | listed, "count_articles").otherwise(s["name"]), s["args"])

    def shaped(s: Column) -> Column:
        allowed, required = F.coalesce(per_tool(s["name"], 0), empty), F.coalesce(per_tool(s["name"], 1), empty)
        ok = (F.size(F.array_except(F.map_keys(s["args"]), allowed)) == 0) & (F.size(F.array_except(required, F.map_keys(s["args"]))) == 0)
        timed = F.array_contains(allowed, "period") & s["args"]["period"].isNull()
        args = F.when(timed, F.map_concat(s["args"], F.create_map(F.lit("period"), F.lit("all")))).otherwise(s["args"])
        tidy = F.transform_values(args, lambda k, v: F.when(k.isin("author", "media"), strip(v)).otherwise(v))
        return F.when(ok, state(s["text"], s["name"], tidy))

    def settled(s: Column) -> Column:
        among = lambda key, values: s["args"][key].isNull() | s["args"][key].isin(*values)
        spoken = lambda key: s["args"][key].isNull() | ((s["args"][key] != "") & (F.length(s["args"][key]) <= 50) & F.contains(s["text"], compact(s["args"][key])))
        ok = s.isNotNull() & among("period", PERIOD_LABELS) & among("category", CATEGORIES) & spoken("author") & spoken("media")
        return F.when(ok, F.struct(s["name"].alias("name"), s["args"].alias("arguments")))

    given = F.map_filter(call["arguments"], lambda k, v: v.isNotNull() & (v != ""))
    known = F.when(call["name"].isin(*TOOLS), state(compact(question), call["name"], given))
    return let(let(let(let(known, moved), renamed), shaped), settled)


def fallback_call(question: Column) -> Column:
    """The keyword rules for questions whose call cannot be read."""
    text, period = compact(question), period_of(question)
    by = has_any(text, BY_CATEGORY_WORDS)
    name = F.when(by, "count_articles_by_category").when(has_any(text, LIST_WORDS), "list_recent_articles").otherwise("count_articles")
    return F.struct(name.alias("name"), period.alias("period"), F.when(~by, category_of(question)).alias("category"))


def has_company_cue(question: Column) -> Column:
    return has_any(compact(question), CUE_WORDS)


def is_no_answer(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?U)[\s.]", "")
    return (bare == "") | bare.contains("답을찾을수없")


def _bare(answer: Column) -> Column:
    return F.regexp_replace(compact(answer), r"\.+$", "")


def answer_in_context(answer: Column, context: Column) -> Column:
    return _bare(answer).isin("예", "아니오") | ((_bare(answer) != "") & F.contains(compact(context), _bare(answer)))


def usable_answer(answer: Column, context: Column) -> Column:
    return ~is_no_answer(answer) & answer_in_context(answer, context)


def echoes_question(answer: Column, question: Column) -> Column:
    return (_bare(answer) != "") & ~_bare(answer).isin("예", "아니오") & F.contains(compact(question), _bare(answer))


def retrieval_scope(question: Column, call: Column, answer: Column, context: Column) -> Column:
    company = call.isNotNull() & call["name"].isin(*TOOLS) & has_company_cue(question)
    here = (strip(context) != "") & usable_answer(answer, context) & ~echoes_question(answer, question)
    return F.when(F.coalesce(company, F.lit(False)), "company_data").when(F.coalesce(here, F.lit(False)), "current_article").otherwise("web")


def without_thoughts(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def keywords(text: Column) -> Column:
    tidy = lambda p: F.regexp_replace(strip(F.regexp_replace(strip(p), "^#+", "")), r"(?U)^\d+[.)]\s*", "")
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,\n]"), tidy), lambda t: t != ""))


def titles(text: Column) -> Column:
    """(title, subtitle) of each line that has both."""
    pattern = r"(?U)제목\s*:\s*(.+?)\s*/\s*부제목\s*:\s*(.+)"
    held = F.filter(lines(text), lambda l: l.rlike(pattern))
    return F.transform(held, lambda l: F.struct(strip(F.regexp_extract(l, pattern, 1)).alias("title"), strip(F.regexp_extract(l, pattern, 2)).alias("subtitle")))


def numbered(text: Column) -> Column:
    pattern = r"(?U)^\s*\d+[.)]\s*(.+)$"
    return F.transform(F.filter(lines(text), lambda l: l.rlike(pattern)), lambda l: strip(F.regexp_extract(l, pattern, 1)))


def verdict(text: Column) -> Column:
    said = F.coalesce(F.nullif(F.regexp_extract(text, r"(?U)판정\s*:\s*(충족|미흡|해당\s*없음)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?U)^\s*(충족|미흡|해당\s*없음)", 1), F.lit("")))
    reason = strip(F.regexp_extract(text, r"(?U)이유\s*:\s*(.+)", 1))
    return F.struct(F.coalesce(F.regexp_replace(said, r"(?U)\s+", " "), F.lit("판정 실패")).alias("verdict"), F.when(said.isNull(), text).otherwise(reason).alias("reason"))


def duplicate_verdict(text: Column) -> Column:
    said = F.nullif(F.regexp_extract(text, r"(?U)판정\s*:\s*(중복\s*의심|중복\s*아님)", 1), F.lit(""))
    reason = strip(F.regexp_extract(text, r"(?U)이유\s*:\s*(.+)", 1))
    return F.when(said.isNotNull(), F.struct(F.regexp_replace(said, r"(?U)\s+", " ").alias("verdict"), reason.alias("reason")))


def category(text: Column, labels: dict[str, str] | None = None) -> Column:
    """A category by name or by its label (문화 is shown as 문화(생활 포함)), else the only one that occurs."""
    said = strip(F.regexp_replace(strip(F.regexp_replace(text, r"(?U)^\s*분야\s*:\s*", "")), r"^\.+|\.+$", ""))
    labels = labels or {}
    exact = first_match([(said.isin(c, labels.get(c, c)), c) for c in CATEGORIES], None)
    found = F.filter(F.array(*[F.lit(c) for c in CATEGORIES]), lambda c: F.contains(said, c))
    return F.coalesce(exact, F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def author(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, r"(?U)\S+@\S+", ""), "[·,/]")
    names = F.array_distinct(F.filter(F.transform(parts, lambda p: strip(F.regexp_replace(strip(p), JOB, ""))), lambda n: n != ""))
    return F.nullif(F.array_join(names, ", "), F.lit(""))


def published_at(text: Column) -> Column:
    """The first date with its time, local; null if there is none or it does not exist."""
    pattern = "(?U)" + DATE
    parts = F.split(F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, r"$1|$2|$3|$4|$5|$6"), r"\|")  # one search in the text

    def told(p: Column) -> Column:
        g = lambda i: F.nullif(F.get(p, F.lit(i - 1)), F.lit(""))
        h = F.coalesce(g(5).cast("int"), F.lit(0))
        h = F.when((g(4) == "오후") & (h < 12), h + 12).when((g(4) == "오전") & (h == 12), 0).otherwise(h)
        stamp = F.try_make_timestamp_ntz(g(1).cast("int"), g(2).cast("int"), g(3).cast("int"), h, F.coalesce(g(6).cast("int"), F.lit(0)), F.lit(0).cast("decimal(8,6)"))
        return F.when(g(1).cast("int") > 0, stamp)

    return let(parts, told)


def metadata(text: Column, article: Column) -> Column:
    """struct(media, author, published_at): what the output claims, kept only where the article bears it out."""
    claim = lambda name: F.nullif(strip(F.regexp_extract(text, rf"(?U){name}\s*:\s*(.+)", 1)), F.lit(""))
    real = lambda x: F.when(~x.rlike(r"(?U)^\(?\s*기사에\s*없음\s*\)?$"), x)
    media, who, when = real(claim("언론사")), author(real(claim("기자"))), published_at(real(claim("작성일")))
    inside = lambda x: F.contains(compact(article), compact(x))
    names = F.split(who, ", ")
    named = F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: compact(n) == compact(media))
    media_ok = inside(media) & ~media.rlike(JOB) & ~media.contains("@") & ~media.rlike("(?U)" + DOMAIN) & ~named
    days = F.transform(F.arrays_zip(*[F.regexp_extract_all(article, F.lit("(?U)" + DATE), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)]), lambda d: F.format_string("%04d-%02d-%02d", d["g1"].cast("int"), d["g2"].cast("int"), d["g3"].cast("int")))
    return F.struct(
        F.when(media_ok, F.left(media, F.lit(255))).alias("media"),
        F.when(F.forall(names, inside), F.left(who, F.lit(255))).alias("author"),
        F.when(F.array_contains(days, F.date_format(when, "yyyy-MM-dd")), when).alias("published_at"),
    )


def meta_lines(held: Column) -> Column:
    """Lines that name a reporter or owner, and the first short line without blanks that is not a number."""
    tidy = F.array_distinct(F.filter(F.transform(held, strip), lambda l: l != ""))
    worded = lambda l: l.rlike("(?i)기자|특파원|ⓒ|copyright")
    short = lambda l: ~worded(l) & (F.length(l) <= 20) & ~l.rlike(r"(?U)\s") & ~l.rlike(r"(?U)^\d+$")
    first = F.get(F.filter(tidy, short), F.lit(0))
    return F.filter(tidy, lambda l: worded(l) | (l == F.coalesce(first, F.lit(""))))


def guideline_items(title_: Column, content: Column) -> Column:
    """A guideline as (title, description) items: one a line, or itself if it has one line."""
    rows = F.filter(F.transform(lines(content), lambda l: strip(F.regexp_replace(l, LIST_MARK, ""))), lambda l: l != "")
    item = lambda a, b: F.struct(a.alias("title"), b.alias("description"))
    head = lambda l: strip(F.substring_index(l, ":", 1))
    split = lambda l: F.when(l.contains(":") & (head(l) != ""), item(head(l), strip(F.substr(l, F.length(F.substring_index(l, ":", 1)) + 2)))).otherwise(item(l, F.lit("")))
    return F.when(F.size(rows) <= 1, F.array(item(strip(title_), strip(content)))).otherwise(F.transform(rows, split))


def title_text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t["title"], F.lit("\n   부제목: "), t["subtitle"])), "\n")


def numbered_text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def message_text(text: Column, empty: str = "결과를 생성하지 못했습니다. 다시 시도해 주세요.") -> Column:
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(empty))


def bounded_context(pieces: Column, most: int = 3000) -> Column:
    """Whole pieces while their sum stays within ``most`` characters; the first that does not fit ends the list."""
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, p: Column) -> Column:
        n = acc["n"] + F.length(p)
        stop = acc["full"] | (n > most)
        return F.struct(F.when(stop, acc["held"]).otherwise(F.concat(acc["held"], F.array(p))).alias("held"), F.when(stop, acc["n"]).otherwise(n).alias("n"), stop.alias("full"))

    return F.aggregate(pieces, start, step, lambda acc: acc["held"])
