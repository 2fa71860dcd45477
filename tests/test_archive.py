"""Literal cases of the archive's functions, and every catalogue query against its SQL."""

import os
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunking, layout, models, parsers, periods, prompts, registry, text
from quillspark.operators import archive, company, constraints, lookups, mutations, requests, vectors
from quillspark.plans import catalogue, catalogue_data, training, validation  # noqa: F401
from quillspark.sources import database, files
from quillspark.streaming import events

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, f, *values):
    """``f`` of literal columns, on one row."""
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'int' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).head()[0]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    tidy = lambda r: str(tuple(round(x, 9) if isinstance(x, float) else x for x in r))
    got = sorted(tidy(r) for r in df.select(*cols).collect())
    if name in catalogue.ORACLE:
        c = con.execute(catalogue.ORACLE[name])
        names = [d[0] for d in c.description]
        assert sorted(names) == cols
        assert got == sorted(tidy([r[names.index(x)] for x in cols]) for r in c.fetchall())


def test_periods():
    now = datetime(2026, 11, 26, 1)
    day = lambda m, d, y=2026: datetime(y, m, d)
    assert periods.bounds("this_week", now) == (day(11, 23), day(11, 30))
    assert periods.bounds("last_month", now) == (day(10, 1), day(11, 1))
    assert periods.bounds("last_7_days", now) == (day(11, 20), day(11, 27))
    assert periods.bounds("last_month", datetime(2026, 1, 5)) == (day(12, 1, 2025), day(1, 1))
    assert periods.bounds("all", now) is None and periods.bounds("tomorrow", now) is None


def test_question_words(spark):
    assert one(spark, periods.period_of, "최근 7일 기사") == "last_7_days" and one(spark, periods.period_of, "기사") == "all"
    assert one(spark, periods.category_of, "it 기사") == "IT" and one(spark, periods.category_of, "edit") is None
    assert one(spark, lambda q: parsers.fallback_call(q)["name"], "분야별 기사") == "count_articles_by_category"
    assert one(spark, lambda q: parsers.fallback_call(q)["name"], "최근 기사 목록") == "list_recent_articles"


def clean_model(t):
    """The chain in plain Python, for comparison."""
    import re

    t = "\n".join(re.sub(r"[ \t]+", " ", x.strip()) for x in t.splitlines())
    t = re.sub(text.REPORTER, "", t, count=1)
    rows = t.splitlines()
    cut = next((i for i, x in enumerate(rows) if any(re.search(p, x.strip()) for p in text.FOOTERS)), None)
    t = t if cut is None else "\n".join(rows[:cut])
    parts, at, out = list(re.finditer(text.MOMENT, t)), 0, ""
    for m in [*parts, None]:
        out += re.sub(r"(?<=\d)[ \t]+(?=\d)", "", t[at : m.start() if m else None]) + (m.group() if m else "")
        at = m.end() if m else at
    t = re.sub(rf"(?<=\d)[ \t]+(?=(?:{text.UNITS})\b)", "", out)
    for p, new in text.REPAIRS:
        t = re.sub(p, new.replace("$1", r"\1"), t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


@pytest.mark.parametrize("t", ["2026.10.14 15:20 에", "1 2 3", "5 명 3 일간", "글\n등록번호 : 1\n뒤", "[새봄 김바다 기자] [새봄 이하늘 기자] 글", "유 품 · 가 ~ 나\n\n\n\n말 했다", "", "Pr e x", "a\tb  c \n d"])
def test_clean(spark, t):
    assert one(spark, text.clean, t) == clean_model(t)


def test_normalize(spark):
    assert one(spark, text.normalize, "▲１０％  a\r\n b") == "10% a\nb"
    assert one(spark, text.problems, " ▲１  a") == ["제거 대상 기호", "전각 문자", "연속 공백/줄바꿈", "앞뒤 공백"]
    assert one(spark, text.title, "", "a.b.txt") == "a.b" and one(spark, text.title, "  ", " .txt") is None


def test_chunks(spark):
    c = lambda n, k=0: lambda t: chunking.chunk(t, n, k)
    assert one(spark, c(8), "aaaa\n\nbb\n\ncccccc\n\ndd\n\nee") == ["aaaa\n\nbb", "cccccc", "dd\n\nee"]
    assert one(spark, c(4), "abcdefghij") == ["abcd", "efgh", "ij"]
    table = "| a | b |\n| --- | :-: |\n| 1 | 2 |"
    assert one(spark, c(10), f"xx\n\n{table}\n\nyy") == ["xx", table, "yy"]
    assert one(spark, c(9), "Aa. Bb. Cccc. Dd.") == ["Aa. Bb.", "Cccc. Dd."]
    assert one(spark, c(16, 1), "aaaa. bb.\n\ncccc. dddd.") == ["aaaa. bb.", "bb.\n\ncccc. dddd."]
    assert one(spark, c(8), "") == []
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunk(F.lit("x"), *bad)


def call(spark, f, q, raw):
    r = one(spark, lambda a, b: F.to_json(f(a, b)), q, raw)
    return r


def test_tool_calls(spark):
    t = lambda raw: one(spark, lambda x: F.to_json(parsers.tool_call(x)), raw)
    assert t('<tool_call>{"name": "count_articles", "arguments": "{\\"period\\": \\"all\\"}"}</tool_call>') == '{"name":"count_articles","arguments":{"period":"all"}}'
    assert t('x {"name": "count_members"} y') == '{"name":"count_members","arguments":{}}'
    for bad in ('<tool_call>{"name": "count_articles",}</tool_call>', "없음", "{잘못된 형식}", '{"arguments": {}}', '{"name": 3}', '{"name": "a", "arguments": [1]}'):
        assert t(bad) is None, bad


def test_checked_calls(spark):
    import json

    c = lambda q, name, **a: one(spark, lambda x, y: F.to_json(parsers.checked_call(parsers.tool_call(y), x)), q, json.dumps({"name": name, "arguments": a}, ensure_ascii=False))
    q = "김바다 기자가 쓴 기사 몇 개야?"
    assert c(q, "unknown_tool") is None and c(q, "count_articles", period="tomorrow") is None
    assert c(q, "count_articles_by_author", author="김가짜") is None and c(q, "count_articles", category="건강") is None
    assert json.loads(c(q, "count_articles_by_author", author=" 김바다 "))["arguments"] == {"author": "김바다", "period": "all"}
    assert json.loads(c("정치부 기사", "count_articles_by_author", author="정치부")) == {"name": "count_articles", "arguments": {"period": "all", "category": "정치"}}
    assert json.loads(c("최근 회사 기사 몇 개야?", "list_recent_articles"))["name"] == "count_articles"
    assert c(q, "count_members", period="all") is None and c(q, "count_articles_by_author") is None


ARTICLE = "새봄신문\n입력 2026.10.14. 오후 3:20\n한빛시는 내년 3월부터 시내버스 120대를 전기버스로 바꾼다고 14일 밝혔다. 교체 비용은 모두 960억 원이다.\n김바다 기자"


def test_output_parsers(spark):
    label = {"문화": "문화(생활 포함)"}
    for said, want in (("정치", "정치"), ("분야: 경제.", "경제"), ("문화(생활 포함)", "문화"), ("모르겠습니다", None), ("정치, 경제", None)):
        assert one(spark, lambda x: parsers.category(x, label), said) == want
    m = lambda raw: one(spark, parsers.metadata, raw, ARTICLE)
    assert tuple(m("언론사: 새봄신문\n기자: 김바다 기자\n작성일: 2026.10.14. 오후 3:20")) == ("새봄신문", "김바다", datetime(2026, 10, 14, 15, 20))
    assert tuple(m("언론사: 한빛일보\n기자: 이하늘 기자\n작성일: 2026.09.13")) == (None, None, None)
    assert m("언론사: 김바다 기자\n기자: 김바다 기자").media is None
    assert one(spark, parsers.keywords, "#전기버스, 한빛시, #전기버스, 교체 비용") == ["전기버스", "한빛시", "교체 비용"]
    assert one(spark, lambda x: parsers.title_text(parsers.titles(x)), "1. 제목: 한빛시, 전기버스 120대 도입 / 부제목: 내년 3월부터 교체 시작") == "1. 한빛시, 전기버스 120대 도입\n   부제목: 내년 3월부터 교체 시작"
    assert one(spark, lambda x: parsers.numbered_text(parsers.numbered(x)), "1) 가\n2) 나") == "1. 가\n2. 나"
    assert tuple(one(spark, parsers.verdict, "판정: 해당  없음\n이유: 까닭")) == ("해당 없음", "까닭") and one(spark, parsers.verdict, "글")["verdict"] == "판정 실패"
    assert tuple(one(spark, parsers.duplicate_verdict, "판정: 중복 의심\n이유: 같다.")) == ("중복 의심", "같다.")
    usable = lambda a: one(spark, parsers.usable_answer, a, ARTICLE)
    assert usable("120대") and usable("예") and not usable("200대")
    assert one(spark, parsers.echoes_question, "전기버스", "수소버스와 전기버스 차이가 뭐야?")
    assert one(spark, lambda x: parsers.meta_lines(F.split(x, "\\|")), "새봄신문|김바다 기자|로그인 메뉴 전체보기") == ["새봄신문", "김바다 기자"]
    assert [tuple(i) for i in one(spark, parsers.guideline_items, "t", "1. 정확: 사실\n- 공정")] == [("정확", "사실"), ("공정", "")]
    assert one(spark, lambda x: parsers.bounded_context(F.split(x, "\\|"), 5), "abc|def|g") == ["abc"]
    assert one(spark, parsers.published_at, "2026년 9월 31일") is None and one(spark, parsers.without_thoughts, "<think>x\ny</think> z ") == "z"


def test_layout(spark):
    rows = F.array(F.array(F.lit("Name"), F.lit("Age")), F.array(F.lit("John"), F.lit("20")))
    table = "| Name | Age |\n| --- | --- |\n| John | 20 |"
    assert spark.range(1).select(layout.markdown_table(rows)).head()[0] == table
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 20.0, "Name"), (1, 60.0, 0.0, 100.0, 20.0, "Age"), (1, 0.0, 25.0, 50.0, 45.0, "John"), (1, 60.0, 25.0, 100.0, 45.0, "20")], "doc int, x0 double, y0 double, x1 double, y1 double, text string")
    assert layout.box_table(boxes, ["doc"]).head().table == table
    assert one(spark, layout.scanned, "Hello world\n\n\nTest") == "Hello world Test"
    assert one(spark, layout.scanned, "<table><tr><th>a&amp;</th><td>b</td></tr></table>") == "| a& | b |\n| --- | --- |"
    page = spark.createDataFrame([(1, 0, 2, 0.0, 50.0, 10.0, 60.0), (1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, None, 0.0, 30.0, 10.0, 40.0)], "page int, box int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert [r.box for r in layout.reading_order(page, ["page"]).orderBy("nth").collect()] == [1, 2, 0]
    lines = spark.createDataFrame([(1, 0, "aaaa bbbb", 0.0, 0.0, 100.0, 10.0), (1, 1, "cccc", 0.0, 12.0, 30.0, 22.0), (1, 2, "dd", 0.0, 24.0, 20.0, 34.0)], "doc int, line int, text string, x0 double, y0 double, x1 double, y1 double")
    assert layout.paragraphs(lines, ["doc"]).head().text == "aaaa bbbb cccc\ndd"
    assert layout.lines_to_boxes(lines, spark.createDataFrame([(1, 5, 0.0, 0.0, 50.0, 23.0), (1, 6, 0.0, 0.0, 80.0, 11.0)], "doc int, box int, x0 double, y0 double, x1 double, y1 double"), ["doc"]).orderBy("line").select("line", "box").collect()[0].box == 6
    b = spark.createDataFrame([([("doc_title", "T"), ("text", "a"), ("header", "h"), ("number", "1"), ("doc_title", "U")],)], "b array<struct<label:string,text:string>>").select(layout.routed(F.col("b")).alias("r")).head().r
    assert (b.title, b.body, b.excluded, b.meta) == ("T", ["a", "U"], ["h", "1"], ["h"])


def test_vectors(spark):
    c = spark.createDataFrame([(1, 1, "먼", [0.0, 1.0]), (2, 1, "가까운", [1.0, 0.0]), (3, 1, "중간", [1.0, 1.0]), (4, 1, "빈", [0.0, 0.0])], "id long, article_id long, content string, embedding array<float>")
    assert [r.content for r in vectors.top_k(c, [1.0, 0.0]).collect()] == ["가까운", "중간", "먼"]
    q = spark.createDataFrame([(9, [1.0, 0.0], 1), (8, [0.0, 1.0], 1)], "query_id long, query_vector array<float>, article_id long")
    found = vectors.neighbours(q, c, ["article_id"], 2)
    assert {r.query_id: r.context for r in vectors.context(found).collect()} == {9: "가까운\n\n중간", 8: "먼\n\n중간"}
    assert sorted(r.id for r in vectors.merged(found).collect()) == [1, 2, 3]
    v = one(spark, models.embed, "a b a")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6 and sum(one(spark, models.embed, "")) == 0


def test_mutations(spark):
    t = spark.createDataFrame([(1, 7, 0), (2, 7, 1), (3, 8, 0)], "id long, article_id long, chunk_index int")
    new = spark.createDataFrame([(9, 7, 0)], t.schema)
    assert sorted(r.id for r in mutations.replaced_chunks(t, new).collect()) == [3, 9]
    assert mutations.replaced_chunks(t, new.unionByName(new)).count() == 3 and mutations.replaced_chunks(t, spark.createDataFrame([(9, 7, -1)], t.schema)).count() == 3
    talks = spark.createDataFrame([(4, 1, 7, "x")], "id long, user_id long, article_id long, title string")
    got = mutations.conversation_for(talks, spark.createDataFrame([(1, 7, "y"), (1, 8, "z"), (1, 8, "z")], "user_id long, article_id long, title string"))
    assert sorted(map(tuple, got.collect())) == [(4, 1, 7, "x"), (5, 1, 8, "z")]
    users = spark.createDataFrame([(1, "a", "member")], "id long, nickname string, role string")
    out = mutations.updated(users, spark.createDataFrame([(1, "b", None)], users.schema), "id", ["nickname", "role"], F.lit(None))
    assert tuple(out.head()) == (1, "b", "member")
    bad = {"users": spark.createDataFrame([(1, "owner", " x", "e"), (2, "admin", "y", "e")], "id long, role string, nickname string, email string")}
    assert {r.rule for r in constraints.audit(bad).collect()} == {"role allowed", "nickname trimmed", "email unique"}
    merged = archive.merge_history(spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"))
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "c")]


def test_training(spark):
    with pytest.raises(ValueError):
        training.quotas(10, {"a": 0.33, "b": 0.33})
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(6)], "id int, g string")
    assert sorted(r.place for r in training.interleaved(rows, "s", "g").where("g = 'a'").collect()) == [0.125, 0.375, 0.625, 0.875]
    with pytest.raises(ValueError):
        training.sample(rows, 7, "s")
    q = validation.quartiles(spark.createDataFrame([(x, "g") for x in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3)], "v int, g string"), "v", "g").head()
    assert (q.q1, q.q2, q.q3) == (1.75, 3.5, 5.25)
    pool = spark.createDataFrame([(1, "g", "x"), (2, "g", "y"), (3, "g", "x"), (4, "h", "x")], "id int, grp string, category string")
    got = training.replacements(spark.createDataFrame([(8, "g", "x"), (9, "g", "x")], pool.schema), pool, "42").collect()
    assert {r.id for r in got} == {1, 3}
    rec = spark.createDataFrame([("t", 1, "span_extraction", "abc", "b", 1, False), ("t", 2, "unanswerable", "abc", "no", None, True)], "split string, id int, question_type string, context string, answer string, answer_start int, is_impossible boolean")
    assert validation.type_rules(rec, "no").count() == 0 and validation.type_rules(rec, "other").count() == 1
    assert {r.rule: r.n for r in validation.report(validation.type_rules(rec, "other")).collect()}["type"] == 1
    assert training.less_records(rows, rows.where("id < 4")).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("﻿글\r\n줄 ".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "c.zip").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.error, r.text) for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.TXT": ("text", None, "글\n줄"), "b.txt": ("text", "invalid file", None), "c.zip": (None, "unsupported format", None)}
    (tmp_path / "qa").mkdir()
    (tmp_path / "qa/x.json").write_text('{"data":[{"doc_id":"d","paragraphs":[{"context":"c","qas":[{"question_id":"q","question":"?","answers":{"text":"c","answer_start":0}}]}]}]}')
    assert files.qa_corpus(spark, str(tmp_path / "qa/x.json"), "TL", "span_extraction").head().id == "q"
    (tmp_path / "sum/sub").mkdir(parents=True)
    (tmp_path / "sum/sub/x.json").write_text('[{"Meta(Refine)":{"passage":"p"},"Annotation":{"summary1":"a","summary3":"c"}}]')
    (tmp_path / "sum/bad.json").write_text("{oops")
    assert [r.Annotation.summary3 for r in files.summary_corpus(spark, str(tmp_path / "sum")).collect()] == ["c"]
    web = spark.createDataFrame([(1, "", "u1", "x" * 520), (2, "t", "u2", None), (3, "t", "u3", "y")], "rank int, title string, url string, content string")
    out = files.web_results(web).collect()
    assert [(r.title, len(r.content)) for r in out] == [("u1", 500), ("t", 1)]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(src))
    q = events.windowed(events.source(spark, str(src))).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).head()[0] == spark.read.parquet(str(src)).count()
    static = spark.read.parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp"))
    assert events.sessions(static).agg(F.sum("n")).head()[0] == static.count()


def test_answer_source_and_final_answer(spark):
    src = lambda a, c: tuple(one(spark, company.answer_source, a, c))
    assert src("서울", "기사는 서울에서 시작한다") == ("current_article", "서울")
    assert src("부산", "기사는 서울에서 시작한다") == ("organization", None)
    assert src(None, "기사") == ("organization", None)
    assert one(spark, company.organization_answer, "답을 찾을 수 없습니다.", "기사") == company.NOT_FOUND
    assert one(spark, company.organization_answer, "기사", "기사") == "기사"
    assert one(spark, company.final_answer, "  ", "답") == company.NOT_FOUND
    assert one(spark, company.final_answer, None, "답") == company.NOT_FOUND
    assert one(spark, company.final_answer, "본문", "답") == "답"
    scope = lambda s: one(spark, company.final_context, s, "a", "o", "w", "c")
    assert [scope(s) for s in ("current_article", "organization", "web", "company_data", "other", None)] == ["a", "o", "w", "c", None, None]


def test_evaluation_text(spark):
    items = "array(named_struct('title','제목','verdict','충족','reason','좋다'), named_struct('title','리드','verdict','판정 실패','reason',''))"
    text_ = spark.sql(f"SELECT {items} AS i").select(company.evaluation_text(F.col("i"))).head()[0]
    assert text_ == "충족 1개, 미흡 0개, 해당 없음 0개, 판정 실패 1개\n\n[충족] 제목\n- 이유: 좋다\n\n[판정 실패] 리드"


def test_company_answers_without_organization_or_model(spark):
    q = spark.createDataFrame([(1, "오늘 기사 몇 건", None), (2, None, None), (None, "목록", "x")], "article_id long, question string, raw string")
    articles = spark.createDataFrame([(1, "t", None, None, None, None)], "id long, title string, published_at timestamp_ntz, category string, author string, media string")
    links, users = spark.createDataFrame([(5, 1)], "user_id long, article_id long"), spark.createDataFrame([(5, 3)], "id long, organization_id long")
    named = spark.createDataFrame([], "id long, organization_id long, title string")
    got = {r.article_id: r.answer for r in company.answered(q, articles, links, users, named, named, datetime(1998, 6, 17)).collect()}
    assert got == {1: "오늘, 전체 분야 기준 회사 기사는 0건입니다.", 2: "", None: ""}


def test_joined_pages(spark):
    def joined(*pages):
        df = spark.createDataFrame([(list(pages),)], "pages array<array<struct<text:string,full:boolean,carry:boolean>>>")
        x = df.select(layout.joined_pages(F.col("pages")).alias("x")).head().x
        return [tuple(b) for b in x.body], list(x.excluded)

    assert joined([("열린", True, False)], [("이어", True, False), ("둘", False, False)], [("셋.", False, False)]) == ([("열린 이어", True), ("둘", False), ("셋.", False)], [])
    assert joined([("가 =", True, False)], [("나", True, False)], [("다.", False, False)], [("라", False, False)]) == ([("가 =나 다.", False), ("라", False)], [])
    assert joined([("열린", True, False)], [("했다.", False, True), ("둘", False, False)]) == ([("열린 했다.", False), ("둘", False)], [])
    assert joined([("끝.", True, False)], [("쪽", False, True), ("둘", False, False)]) == ([("끝.", True), ("둘", False)], ["쪽"])
    assert joined([("쪽", False, True)], None, []) == ([], ["쪽"])
    assert joined() == ([], [])


def test_reading_order_ties_and_groups(spark):
    rows = [(1, 1, 1, 0.0, 10.0, 0.0, 10.0), (1, 2, None, 0.0, 10.0, 0.0, 20.0), (1, 3, 2, 0.0, 10.0, 30.0, 40.0)]
    boxes = spark.createDataFrame(rows, "page int, box int, ord int, x0 double, x1 double, y0 double, y1 double")
    assert [r.box for r in layout.reading_order(boxes, ["page"]).orderBy("nth").collect()] == [1, 2, 3]


def test_change_rules(spark):
    run = lambda c: tuple(spark.range(1).select(c.alias("x")).head().x)
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("string")
    assert run(lookups.article_update(no, F.lit("t"), none))[0] == 404
    assert run(lookups.article_update(yes, none, none)) == (400, "nothing to change")
    assert run(lookups.article_update(yes, F.lit(" \t"), none)) == (400, "blank title")
    assert run(lookups.article_update(yes, F.lit("t"), F.lit("secret"))) == (400, "unknown visibility")
    assert run(lookups.article_update(yes, F.lit("t"), F.lit("public"))) == (200, "")
    assert run(lookups.member_update(yes, F.lit(1), F.lit(1), F.lit("admin"), F.lit("member"))) == (400, "own role")
    assert run(lookups.member_update(yes, F.lit(1), F.lit(1), F.lit("admin"), none)) == (200, "")
    assert run(lookups.member_update(no, F.lit(2), F.lit(1), F.lit("admin"), F.lit("owner"))) == (400, "unknown role")
    assert run(lookups.member_delete(yes, F.lit(1), F.lit(1)))[0] == 400
    assert run(lookups.member_delete(no, F.lit(2), F.lit(1)))[0] == 404


def test_lookups_and_counts(spark):
    t = spark.createDataFrame([(2, "a"), (1, "a"), (3, None)], "id int, k string")
    assert [r.id for r in lookups.one_by_key(t, k="a").collect()] == [1] and lookups.by_key(t, k=None).count() == 0
    df = spark.createDataFrame([("train", "x")] * 3 + [("train", "z")], "split string, question_type string")
    got = {r.message for r in validation.counts(df, {("train", "x"): 3, ("train", "y"): 2}).collect()}
    assert got == {"y: 0 of 2", "z: 1 of 0"}


def test_created_at_stands_in(spark):
    articles = spark.sql("SELECT 1L AS id, 't' AS title, CAST(NULL AS timestamp_ntz) AS published_at, TIMESTAMP_NTZ '1998-06-17 00:30:00' AS created_at, 'c' AS category")
    links, users = spark.createDataFrame([(5, 1)], "user_id long, article_id long"), spark.createDataFrame([(5, 3)], "id long, organization_id long")
    scope = archive.scoped(articles, links, users, "today", datetime(1998, 6, 17, 1))
    assert [r.n for r in archive.count_articles(scope).collect()] == [1]
    assert archive.recent(scope).head().published_at == datetime(1998, 6, 17, 0, 30)


def test_display(spark):
    assert one(spark, text.file_size, 1536) == "1.5 KB"
    assert one(spark, text.initial, " kim") == "K"
    df = spark.sql("SELECT TIMESTAMP_NTZ '2026-01-02 03:04:05' AS t UNION ALL SELECT NULL").select(text.shown_date(F.col("t")).alias("d"))
    assert sorted(r.d for r in df.collect()) == ["2026-01-02", "정보 없음"]
    codes = [r.c for r in spark.range(20).select(text.org_code().alias("c")).collect()]
    assert all(len(c) == 10 and c.isalnum() and c == c.upper() for c in codes) and len(set(codes)) == 20


def test_summary_sets(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id int, t string")
    rows = training.summary_sets(df, 12, 5, "s").collect()
    ids = lambda k: {r.id for r in rows if r.split == k}
    assert (len(ids("train")), len(ids("golden"))) == (12, 5) and not ids("train") & ids("golden")
    with pytest.raises(ValueError):
        training.summary_sets(df, 18, 5, "s").collect()


def test_request_rules(spark):
    got = lambda kind, *v: one(spark, lambda *c: requests.problems(kind, **dict(zip(requests.REQUESTS[kind], c, strict=True))), *v)
    assert got("register", "a.b@example.com", "pw", " n ", "ORG", "") == []
    assert got("register", "a@b", "x" * 129, "  ", "", "y" * 51) == ["email: no address", "password: longer than 128", "nickname: blank", "organization_code: empty", "admin_code: longer than 50"]
    assert got("message", " \n") == ["content: blank"]
    assert got("article_update", "", "") == ["title: empty"]
    df = spark.range(1)
    assert df.select(requests.problems("login").alias("x")).head()[0] == ["email: missing", "password: missing"]
    assert df.select(requests.problems("member_update").alias("x")).head()[0] == []
    with pytest.raises(ValueError):
        requests.problems("login", nickname=F.lit("x"))


def test_prompts(spark):
    assert one(spark, lambda a, b: prompts.rendered("{x}: {y}{x}", x=a, y=b), "{y}", "b") == "{y}: b{y}"
    with pytest.raises(ValueError):
        prompts.rendered("{x}")
    df = spark.sql("SELECT transform(sequence(1, 12), i -> named_struct('role', 'user', 'content', string(i))) AS h, 'q' AS q UNION ALL SELECT NULL, NULL")
    held, empty = (r[0] for r in df.select(prompts.chat("s", F.coalesce("q", F.lit("")), [("a", "b")], F.col("h"))).collect())
    assert [(m.role, m.content) for m in held[:4]] == [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "3")]
    assert len(held) == 14 and held[-1].content == "q"
    assert [m.content for m in empty] == ["s", "a", "b", ""]


def test_record_rules(spark):
    good = '{"id": "a", "question_type": "x", "question": "q", "context": "c", "answer": "a", "answer_start": 1, "evidence": null, "is_impossible": false, "metadata": {"doc_id": 1, "doc_title": 1, "source": 1, "published": 1, "category": 1, "source_split": 1}}'
    bad = good.replace('"answer_start": 1', '"answer_start": true').replace('"question": "q"', '"question": " "').replace('"context": "c", ', "").replace('"category": 1, ', "").replace('"x"', '"y"')
    df = spark.createDataFrame([("t", 0, good), ("t", 1, bad), ("t", 2, "[1]"), ("t", 3, "{"), ("t", 4, None)], "split string, pos int, record string")
    got = {r.id: r.message for r in validation.field_rules(df, ("x",)).collect()}
    assert got == {"a": "question blank, context missing, answer_start of another kind, metadata.category missing, unknown question_type: y", "#2": "not an object", "#3": "not an object", "#4": "not an object"}
    rows = spark.createDataFrame([("train", "1", "TL"), ("train", "2", "VL"), ("gold", "3", None)], "split string, id string, source_split string")
    assert {(r.id, r.message) for r in validation.source_rules(rows, {"train": "TL", "gold": "VL"}).collect()} == {("2", "source VL instead of TL"), ("3", "source null instead of VL")}


def test_sql_functions(spark):
    assert set(registry.register(spark)) >= {"cosine_distance", "content_hash"}
    r = spark.sql("SELECT cosine_distance(array(float(1), float(0)), array(float(0), float(2))) AS d, compact(' a b') AS c, content_hash('') AS h").head()
    assert abs(r.d - 1) < 1e-9 and r.c == "ab" and r.h.startswith("e3b0c442")


def test_relational(spark):
    url = "jdbc:derby:memory:quillspark;create=true"
    rows = [(i, f"t{i}" if i % 3 else None) for i in range(-5, 40)]
    database.write_relational(spark.createDataFrame(rows, "id long, title string"), url, "articles", "overwrite")
    df = database.relational(spark, url, "articles", '"id"', rows_per_task=10)
    assert df.rdd.getNumPartitions() == 5 and sorted(map(tuple, df.collect())) == rows
    assert database.relational(spark, url, "articles").where("id > 30").count() == 9


def test_layout_regions(spark):
    line = "doc int, page int, box int, label string, x0 double, y0 double, x1 double, y1 double"
    held = spark.createDataFrame([(1, 1, 0, "text", 0.0, 0.0, 100.0, 10.0), (1, 1, 0, "text", 0.0, 12.0, 98.0, 22.0), (1, 1, 1, "text", 0.0, 14.0, 99.0, 24.0)], line)
    loose = spark.createDataFrame([(1, 1, 0, 1.0, 24.0, 50.0, 34.0), (1, 1, 1, 40.0, 24.0, 50.0, 34.0), (1, 1, 2, 0.0, 24.0, 50.0, 44.0)], "doc int, page int, line int, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in layout.continued_lines(loose, held, ["doc", "page"]).collect()] == [(1, 1, 0, 0)]
    assert layout.continued_lines(loose, held, ["doc", "page"], skip=("text",)).count() == 0
    box = "doc int, page int, box int, label string, n_lines int, ord int, x0 double, y0 double, x1 double, y1 double"
    boxes = spark.createDataFrame([(1, 1, 0, "text", 0, 3, 1.0, 1.0, 9.0, 4.0), (1, 1, 1, "text", 0, 2, 1.0, 5.0, 9.0, 9.0), (1, 1, 2, "table", 0, None, 20.0, 0.0, 30.0, 9.0), (1, 1, 3, "text", 1, 1, 1.0, 1.0, 2.0, 2.0), (1, 2, 0, "text", 0, 1, 0.0, 0.0, 5.0, 5.0)], box)
    images = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 0.0, 0.0, 40.0, 40.0), (1, 2, 0, 0.0, 0.0, 10.0, 10.0), (1, 3, 0, 0.0, 0.0, 1.0, 1.0)], "doc int, page int, image int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r) for r in layout.boxes_in_images(boxes, images, ["doc", "page"]).collect())
    assert got == [(1, 1, 0, [0, 1], 2, 1.0, 1.0, 9.0, 9.0), (1, 1, 1, [2], None, 20.0, 0.0, 30.0, 9.0)]


def test_reading_order_by_hand(spark):
    wide, left, right = (0.0, 100.0), (0.0, 10.0), (50.0, 60.0)
    pages = {  # (box, number, sides, top, bottom) and the order that follows
        1: ([(1, 1, wide, 0, 10), (2, None, left, 20, 30), (3, None, left, 100, 110)], [1, 2, 3]),  # two strips, one below the other
        2: ([(1, 1, wide, 0, 10), (2, None, left, 20, 30), (3, None, right, 20, 30)], [1, 3, 2]),  # side by side: the latest first
        3: ([(1, 1, left, 50, 60), (2, None, left, 0, 10), (3, None, right, 0, 10)], [3, 2, 1]),  # nothing above
        4: ([(1, 1, wide, 0, 10), (2, None, left, 20, 30), (3, None, left, 40, 50), (4, 2, wide, 35, 38)], [1, 2, 3, 4]),  # one strip of two
        5: ([(1, 2, wide, 0, 10), (2, 1, wide, 20, 30), (3, None, left, 5, 8), (4, None, right, 90, 95)], [2, 1, 4, 3]),  # numbers against the page: the anchor is the last in order, not on the page
        6: ([(1, 1, left, 0, 10), (2, 2, right, 0, 10), (3, None, left, 20, 30), (4, None, right, 40, 50), (5, None, wide, 60, 70)], [1, 3, 2, 4, 5]),
    }
    rows = [(p, b, n, x0, x1, float(y0), float(y1)) for p, (held, _) in pages.items() for b, n, (x0, x1), y0, y1 in held]
    df = spark.createDataFrame(rows[::-1], "page int, box int, ord int, x0 double, x1 double, y0 double, y1 double")
    got = layout.reading_order(df, ["page"]).orderBy("page", "nth").collect()
    assert {p: [r.box for r in got if r.page == p] for p in pages} == {p: order for p, (_, order) in pages.items()}


def test_reading_order_keeps_numbers(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for page in range(200):
        for box, n in enumerate(rnd.sample(range(20), rnd.randrange(1, 9))):
            x, y = float(rnd.randrange(0, 60, 5)), float(rnd.randrange(0, 100, 5))
            rows.append((page, box, n if rnd.random() < 0.5 else None, x, x + rnd.randrange(5, 50), y, y + rnd.randrange(5, 25)))
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "page int, box int, ord int, x0 double, x1 double, y0 double, y1 double")
    got = layout.reading_order(df, ["page"]).orderBy("page", "nth").collect()
    number = {(p, b): n for p, b, n, *_ in rows}
    assert sorted((r.page, r.box) for r in got) == sorted(number) and all(r.nth == i - min(j for j, q in enumerate(got) if q.page == r.page) for i, r in enumerate(got))
    for page in range(200):
        told = [number[r.page, r.box] for r in got if r.page == page]
        assert [n for n in told if n is not None] == sorted(n for n in told if n is not None)
    # a box without number that starts above all numbered ones comes first
    first = {p: min((y0, b) for q, b, n, x0, x1, y0, y1 in rows if q == p) for p in range(200)}
    for page, (_, b) in first.items():
        order = [r.box for r in got if r.page == page]
        if number[page, b] is None and all(number[page, x] is not None for x in order if x != b) and all(y0 > first[page][0] for q, x, n, x0, x1, y0, y1 in rows if q == page and x != b):
            assert order[0] == b


def test_settings_and_file_errors(spark, tmp_path):
    from quillspark.plans import settings

    files_ = {"a": '{"seed": 7, "sizes": {"training": 10}, "excluded_ids": [1, "b"]}', "b": "[1, 2", "c": '{"x": 1}', "d": "[]", "e": ""}
    for name, content in files_.items():
        (tmp_path / f"{name}.json").write_text(content)
    s = settings.settings(spark, f"{tmp_path}/a.json")
    assert (s.seed, s.sizes, s.excluded_ids) == (7, {"training": 10}, ("1", "b")) and s.output_file("golden") == "processed/golden.json" and s.raw_file("x", "y") == "raw/x/y.json"
    with pytest.raises(ValueError):
        settings.parsed('{"other": 1}')
    got = {r.split: r.message for r in files.file_errors(spark, {k: f"{tmp_path}/{k}.json" for k in "bcdef"}).collect()}
    assert got == {"b": "not JSON", "c": "not an array", "e": "missing or empty", "f": "missing or empty"}


def test_numbered_in_ranges(spark):
    from quillspark.operators.order import numbered

    df = spark.range(5000).selectExpr("(id * 7919) % 1000 AS k", "id").repartition(6)
    got = [(r.k, r.id, r.nth) for r in numbered(df, ["k", "id"], "nth", 10, rows_per_task=300).collect()]
    assert [(k, i) for k, i, _ in sorted(got, key=lambda r: r[2])] == sorted((k, i) for k, i, _ in got) and sorted(n for *_, n in got) == list(range(10, 5010))
    assert numbered(df.limit(0), ["k"], "nth").count() == 0 and numbered(spark.sql("SELECT CAST(NULL AS INT) AS k"), ["k"], "nth").head().nth == 0
    new = spark.createDataFrame([(f"t{i}",) for i in range(20)], "title string")
    out = mutations.appended(spark.createDataFrame([(4, "a")], "id long, title string"), new)
    assert sorted(r.id for r in out.collect()) == [4, *range(5, 25)]


def test_replacements_are_settled_in_turn(spark):
    row = "id string, grp string, category string"
    removed = spark.createDataFrame([("r1", "g", "x"), ("r2", "g", "x"), ("r3", "h", "y")], row)
    pool = spark.createDataFrame([("a", "g", "x"), ("b", "g", "z"), ("c", "h", "x")], row)
    got = {r.removed_id: r.id for r in training.replacements(removed, pool, "42").collect()}
    assert got == {"r1": "a", "r2": "b", "r3": "c"}
    with pytest.raises(ValueError):
        training.replacements(removed, pool.where("id <> 'b'"), "42")


def test_slots_and_coercion(spark):
    df = spark.createDataFrame([("t", 1)], "text string, n int")
    assert df.select(company.spoken_text(df).alias("x")).head().x == "t"
    with pytest.raises(TypeError):
        company.spoken_text(df.select("n"))
    assert one(spark, lambda c: text.normal_map(c), "  a😀 \n b ") == [2, 3, 4, 7]
    assert one(spark, lambda c: text.normal_map(c), " \n") == [] and one(spark, lambda c: text.normal_map(c), "") == []
