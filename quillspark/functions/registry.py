"""SQL functions of a session: expressions of built-in functions, so queries that use them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "cosine_distance": (
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
        "DOUBLE",
        "1 - aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (m, x) -> m + x)"
        " / (sqrt(aggregate(a, 0D, (m, x) -> m + double(x) * double(x))) * sqrt(aggregate(b, 0D, (m, x) -> m + double(x) * double(x))))",
    ),
    "content_hash": ("body STRING", "STRING", "sha2(cast(body AS BINARY), 256)"),
    "compact": ("body STRING", "STRING", r"regexp_replace(body, r'(?U)\s+', '')"),
}


# ---------------------------------------------------------------- SQL text of chunking: what ``chunking.chunk`` says in columns


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value`` once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, r'(?U)^\s+|\s+$', '')"


def _pieces(array: str, name: str) -> str:
    """Stripped elements that are not blank."""
    return f"filter(transform({array}, {name} -> {_strip(name)}), {name} -> {name} <> '')"


def _is_table(x: str) -> str:
    framed = lambda l: f"startswith({l}, '|') AND endswith({l}, '|')"
    cells = r"split(regexp_replace(rows[1], r'^\||\|$', ''), r'\|', -1)"
    ruled = rf"forall({cells}, cell -> rlike({_strip('cell')}, r'^[-: ]*-[-: ]*$'))"
    return _let(_pieces(rf"split({x}, r'\R')", "l"), "rows", f"CASE WHEN size(rows) < 2 THEN false ELSE {framed('rows[0]')} AND {framed('rows[1]')} AND {ruled} END")


def _packed(items: str, size: str, joiner: str) -> str:
    """Greedy packing of (text, fixed) elements: fixed ones stand alone, others are joined while they fit."""
    flush = "CASE WHEN acc.cur = '' THEN acc.done ELSE concat(acc.done, array(acc.cur)) END"
    state = lambda done, cur: f"named_struct('done', {done}, 'cur', {cur})"
    fits = f"acc.cur <> '' AND length(acc.cur) + length({joiner}) + length(x.text) <= {size}"
    step = f"CASE WHEN x.fixed THEN {state(f'concat({flush}, array(x.text))', quote(''))} WHEN {fits} THEN {state('acc.done', f'concat(acc.cur, {joiner}, x.text)')} ELSE {state(flush, 'x.text')} END"
    return f"aggregate({items}, {state('cast(array() AS ARRAY<STRING>)', quote(''))}, (acc, x) -> {step}, acc -> {flush})"


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _element(text: str, fixed: str) -> str:
    return f"named_struct('text', {text}, 'fixed', {fixed})"


def chunk_sql(body: str, size: str, paragraph: str) -> str:
    """The chunks of a text as an array expression in SQL."""
    sentences = _pieces(r"regexp_extract_all(p, r'[^.!?\n]+[.!?]*', 0)", "s")
    slices = f"transform(sequence(0, length(s) - 1, {size}), i -> {_element(f'substr(s, i + 1, {size})', 'true')})"
    parts = f"flatten(transform({sentences}, s -> CASE WHEN length(s) > {size} THEN {slices} ELSE array({_element('s', 'false')}) END))"
    long = f"transform({_packed(parts, size, quote(' '))}, c -> {_element('c', 'true')})"
    of = _let(_is_table("p"), "tabular", f"CASE WHEN length(p) > {size} AND NOT tabular THEN {long} ELSE array({_element('p', 'tabular')}) END")
    paragraphs = _pieces(f"split(coalesce({body}, ''), {paragraph})", "q")
    return _packed(f"flatten(transform({paragraphs}, p -> {of}))", size, quote("\n\n"))


#: Table functions, for LATERAL: name -> (arguments, columns, query).
TABLE_FUNCTIONS = {
    "chunk_rows": (
        "body STRING, chunk_size INT, paragraph STRING",
        "chunk_index INT, content STRING",
        f"SELECT pos, col FROM (SELECT posexplode({chunk_sql('body', 'chunk_size', 'paragraph')}))",
    ),
    "sentence_rows": (
        "body STRING",
        "sentence_index INT, content STRING",
        "SELECT pos, col FROM (SELECT posexplode(" + _pieces(r"regexp_extract_all(coalesce(body, ''), r'[^.!?\n]+[.!?]*', 0)", "s") + "))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """All functions in this session; null and empty texts give no rows of a table function."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, (args, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({columns}) RETURN {body}")
    return [*FUNCTIONS, *TABLE_FUNCTIONS]
