"""Queries over the paths that hold at scale: pruned and indexed search, order statistics, changes, streams, learned models."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import chunking, feature_prompts, learned, registry, text
from quillspark.operators import constraints, evaluation, neighbours
from quillspark.operators.snapshots import Store, replace_chunks
from quillspark.operators.storage import fresh_path, saved
from quillspark.sources import files
from quillspark.streaming import uploads

from . import training
from .catalogue import _NEAR, ORACLE, SCOPE, query
from .catalogue_data import _CHUNKS, _MARK, BLANKS
from .views import Archive


# ---------------------------------------------------------------- nearest neighbours


def _asked(a: Archive) -> DataFrame:
    return a.chunks.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), "article_id")


@query(f", {_NEAR} SELECT query_id, id, nth FROM near WHERE nth <= 20")
def knn_pruned(a: Archive) -> DataFrame:
    """The 20 nearest chunks of every query chunk in its article, through cells and bounds."""
    return neighbours.exact(_asked(a), neighbours.build(a.chunks, ["article_id"]), ["article_id"], 20).select("query_id", "id", "nth")


@query(f", {_NEAR} SELECT count(*) AS n, true AS recalled FROM near WHERE nth <= 20")
def knn_index_recall(a: Archive) -> DataFrame:
    """How many true neighbours there are, and whether the index finds nine in ten of them with probes chosen for 0.95."""
    index = neighbours.build(a.chunks, ["article_id"])
    true = neighbours.exact(_asked(a), index, ["article_id"], 20)
    found = neighbours.approximate(_asked(a), index, ["article_id"], 20, neighbours.calibrated(_asked(a), index, ["article_id"], 20))
    both = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("n"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled"))


# ---------------------------------------------------------------- SQL alone


@query(_CHUNKS + " SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, content FROM rows")
def chunk_rows_in_sql(a: Archive) -> DataFrame:
    """The chunks of every document, by a table function and LATERAL."""
    registry.register(a.spark)
    a.raw("documents").createOrReplaceTempView("chunk_documents")
    return a.spark.sql(r"SELECT doc_id, c.chunk_index, c.content FROM chunk_documents, LATERAL chunk_rows(text, 300, '\n') c")


# ---------------------------------------------------------------- changes


@query(ORACLE["constraint_audit"].split(SCOPE, 1)[1])
def audit_of_changes(a: Archive) -> DataFrame:
    """An audit of all but a tenth of the links and messages and some that do not belong, then of the change that puts this right."""
    links, messages, articles = a.links, a.messages, a.articles
    links = links.repartition(max(1, -(-links.count() // 250_000)), "user_id", "article_id").distinct()  # a task's rows are few
    wrong = links.where("article_id % 10 = 3").select("user_id", (-F.col("article_id")).alias("article_id"))
    early = {"organizations": a.organizations, "users": a.users, "articles": articles.where("id % 10 <> 4"), "user_articles": links.withColumn("article_id", F.expr("if(article_id % 10 = 3, -article_id, article_id)")), "article_chunks": a.chunks.drop("embedding"), "messages": messages.where("conversation_id % 10 <> 5")}
    store = Store(a.spark, fresh_path(a.spark, "audited"))
    constraints.begin_audit(store, early)
    added = {"user_articles": links.where("article_id % 10 = 3"), "messages": messages.where("conversation_id % 10 = 5"), "articles": articles.where("id % 10 = 4")}
    return constraints.audit_change(store, added, {"user_articles": wrong})


@query("SELECT id, article_id, chunk_index, CAST(embedding AS FLOAT[]) AS embedding FROM article_chunks WHERE article_id <> 3 UNION ALL SELECT 1000000 + id, 3, chunk_index, CAST(embedding AS FLOAT[]) FROM article_chunks WHERE article_id = 4")
def staged_replacement(a: Archive) -> DataFrame:
    """The chunks of one article replaced by another's, through a store whose versions switch as a whole."""
    store = Store(a.spark, fresh_path(a.spark, "chunks"))
    chunks = a.chunks.select("id", "article_id", "chunk_index", "embedding")
    with store.change() as change:
        change.create("article_chunks", chunks, "article_id")
    new = chunks.where("article_id = 4").withColumns({"id": F.col("id") + 1_000_000, "article_id": F.lit(3).cast("long")})
    return store.read("article_chunks", replace_chunks(store, new))


@query("""SELECT arg_min(doc_id, [doc_id % 2, doc_id]) AS upload_id, organization_id, content_hash FROM (SELECT doc_id, CAST(doc_id % 5 AS BIGINT) AS organization_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> '') GROUP BY 2, 3""")
def streamed_uploads(a: Archive) -> DataFrame:
    """Every document uploaded to one of five organisations, as a stream of two batches, even ids first: what is stored."""
    base = fresh_path(a.spark, "uploads")
    docs = a.raw("documents").select((F.col("doc_id") % 5).alias("organization_id"), F.col("source").alias("title"), F.col("text").alias("body"), F.timestamp_seconds("doc_id").alias("uploaded_at"), F.col("doc_id").alias("upload_id"))
    store = Store(a.spark, f"{base}/store")
    for part in ("upload_id % 2 = 0", "upload_id % 2 = 1"):
        docs.where(part).write.mode("append").json(f"{base}/in")
        uploads.started(a.spark, f"{base}/in", store, f"{base}/checkpoint", files_per_batch=10_000, late=timedelta(days=400_000)).awaitTermination()
    return store.read("articles").groupBy("organization_id", "content_hash").agg(F.min("upload_id").alias("upload_id"))


# ---------------------------------------------------------------- features of the model, from prompt to message


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_prompt(name: str) -> str:
    """The transcript of a feature in SQL: what is the same for all rows, then the template with its places replaced."""
    feature, fixed = feature_prompts.FEATURES[name], ""
    if feature.system is not None:
        fixed += f"system: {feature.system}\n\n"
    for given, answer in feature.shots:
        asked = feature.template
        for k, v in given.items():
            asked = asked.replace("{" + k + "}", v)
        fixed += f"user: {asked}\n\nassistant: {answer}\n\n"
    user = _sql_text(feature.template)
    for place in _PLACES:
        user = f"replace({user}, '{{{place}}}', {_PLACES[place]})" if f"{{{place}}}" in feature.template else user
    return f"{_sql_text(fixed)} || 'user: ' || {user}"


_PLACES = {"title": "coalesce(lang, '')", "description": "coalesce(source, '')", "template": "coalesce(source, '')", "similar": "coalesce(source, '')", "question": "coalesce(source, '')", "article": "coalesce(text, '')", "passage": "coalesce(text, '')", "context": "coalesce(text, '')"}


@query("SELECT doc_id, f.feature, sha256(f.told) AS digest, f.n AS n_messages FROM documents, LATERAL (SELECT unnest([" + ", ".join(f"{{'feature': '{n}', 'told': {_sql_prompt(n)}, 'n': {1 + (f.system is not None) + 2 * len(f.shots)}}}" for n, f in feature_prompts.FEATURES.items()) + "]) AS f)")
def feature_messages(a: Archive) -> DataFrame:
    """The messages of all eleven features for every document."""
    column = {"title": "lang", "description": "source", "template": "source", "similar": "source", "question": "source", "article": "text", "passage": "text", "context": "text"}
    told = []
    for name, feature in feature_prompts.FEATURES.items():
        held = feature_prompts.messages(name, **{p: F.col(c) for p, c in column.items() if f"{{{p}}}" in feature.template})
        told.append(F.struct(F.lit(name).alias("feature"), F.sha2(feature_prompts.transcript(held).cast("binary"), 256).alias("digest"), F.size(held).alias("n_messages")))
    return a.raw("documents").select("doc_id", F.explode(F.array(*told)).alias("f")).select("doc_id", "f.*")


_ANSWER = "CASE (len(body) + item + len(title)) % 5 WHEN 0 THEN '판정: 충족' || chr(10) || '이유:  ' || left(title, 20) WHEN 1 THEN '<think>a' || chr(10) || 'b</think> 미흡' WHEN 2 THEN '판정:  해당  없음' || chr(10) || '이유: ' || left(description, 9) || ' .' WHEN 3 THEN ' 글쎄 ' || item END"


@query(rf""", g AS (SELECT item_id % 5 AS organization_id, item_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(regexp_replace(l, '{_MARK}', ''), {BLANKS})), lambda l: l <> '') AS ls, trim(coalesce(text, ''), {BLANKS}) AS content FROM benchmark),
i AS (SELECT organization_id, item_id, unnest(CASE WHEN len(ls) <= 1 THEN [NULL] ELSE ls END) AS l, generate_subscripts(CASE WHEN len(ls) <= 1 THEN [NULL] ELSE ls END, 1) - 1 AS item, content FROM g),
t AS (SELECT organization_id, item_id, item, CASE WHEN l IS NULL THEN 'g' || item_id WHEN contains(l, ':') AND trim(split_part(l, ':', 1), {BLANKS}) <> '' THEN trim(split_part(l, ':', 1), {BLANKS}) ELSE l END AS title,
    CASE WHEN l IS NULL THEN content WHEN contains(l, ':') AND trim(split_part(l, ':', 1), {BLANKS}) <> '' THEN trim(substr(l, strpos(l, ':') + 1), {BLANKS}) ELSE '' END AS description FROM i),
r AS (SELECT doc_id, item_id, item, title, trim(regexp_replace(coalesce({_ANSWER}, ''), '(?s)<think>.*?</think>', ''), {BLANKS}) AS raw FROM (SELECT doc_id, doc_id % 5 AS organization_id, coalesce(text, '') AS body FROM documents) d JOIN t USING (organization_id)),
v AS (SELECT *, CASE WHEN regexp_matches(raw, '판정\s*:\s*(충족|미흡|해당\s*없음)') THEN regexp_extract(raw, '판정\s*:\s*(충족|미흡|해당\s*없음)', 1) ELSE regexp_extract(raw, '^\s*(충족|미흡|해당\s*없음)', 1) END AS said FROM r),
w AS (SELECT doc_id, item_id, item, title, CASE WHEN said = '' THEN '판정 실패' ELSE regexp_replace(said, '\s+', ' ', 'g') END AS verdict, CASE WHEN said = '' THEN raw ELSE trim(regexp_extract(raw, '이유\s*:\s*(.+)', 1), {BLANKS}) END AS reason FROM v),
n AS (SELECT doc_id, count(*) FILTER (WHERE verdict = '충족') AS met, count(*) FILTER (WHERE verdict = '미흡') AS short, count(*) FILTER (WHERE verdict = '해당 없음') AS none, count(*) FILTER (WHERE verdict = '판정 실패') AS failed,
    string_agg(chr(10) || '[' || verdict || '] ' || title || CASE WHEN reason <> '' THEN chr(10) || '- 이유: ' || reason ELSE '' END, chr(10) ORDER BY item_id, item) AS told FROM w GROUP BY doc_id)
SELECT doc_id AS article_id, met, short, none, failed, sha256(trim('충족 ' || met || '개, 미흡 ' || short || '개, 해당 없음 ' || none || '개' || CASE WHEN failed > 0 THEN ', 판정 실패 ' || failed || '개' ELSE '' END || chr(10) || told, {BLANKS})) AS digest FROM n""")
def article_evaluations(a: Archive) -> DataFrame:
    """Every document against every item of its organisation's guidelines (the benchmark's texts), from items over answers to tally and message."""
    articles = a.raw("documents").select(F.col("doc_id").alias("article_id"), (F.col("doc_id") % 5).alias("organization_id"), F.coalesce("text", F.lit("")).alias("body"))
    guidelines = a.raw("benchmark").select((F.col("item_id") % 5).alias("organization_id"), F.col("item_id").alias("id"), F.concat(F.lit("g"), F.col("item_id").cast("string")).alias("title"), F.col("text").alias("content"))

    def model(questions: DataFrame) -> DataFrame:
        """A stand-in that answers in five manners."""
        manner = (F.length("body") + F.col("item") + F.length("title")) % 5
        good = F.concat(F.lit("판정: 충족\n이유:  "), F.left("title", F.lit(20)))
        none = F.concat(F.lit("판정:  해당  없음\n이유: "), F.left("description", F.lit(9)), F.lit(" ."))
        return questions.withColumn("raw", F.when(manner == 0, good).when(manner == 1, "<think>a\nb</think> 미흡").when(manner == 2, none).when(manner == 3, F.concat(F.lit(" 글쎄 "), F.col("item").cast("string"))))

    told = evaluation.evaluated(evaluation.graded(evaluation.asked(articles, guidelines), model))
    return told.select("article_id", "met", "short", "none", "failed", F.sha2(F.col("message").cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, sha256('다음 원문의 핵심 내용을 한국어로 간결하게 요약하세요. 원문에 없는 사실은 추가하지 마세요.' || chr(10) || chr(10) || '### 원문 텍스트:' || chr(10) || coalesce(text, '')) AS summary_prompt, sha256('주어진 뉴스 본문을 읽고 질문에 답하세요. 정답만 간결하게 답하세요. /no_think' || chr(10) || chr(10) || '뉴스 본문:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '질문:' || chr(10) || coalesce(source, '')) AS answer_prompt, coalesce(lang, '') AS completion FROM documents")
def training_messages(a: Archive) -> DataFrame:
    """Training examples of both adapters for every document, worded as at inference."""
    d = a.raw("documents")
    both = d.select("doc_id", *(c.alias(f"{n}_{p}") for n, pair in (("s", training.summary_example(F.col("text"), F.col("lang"))), ("a", training.answer_example(F.col("text"), F.col("source"), F.col("lang")))) for p, c in zip(("p", "c"), pair, strict=True)))
    digest = lambda c: F.sha2(F.col(c)[0]["content"].cast("binary"), 256)
    return both.where("size(s_p) = 1 AND size(a_p) = 1 AND s_c[0].content = a_c[0].content").select("doc_id", digest("s_p").alias("summary_prompt"), digest("a_p").alias("answer_prompt"), F.col("a_c")[0]["content"].alias("completion"))


# ---------------------------------------------------------------- models that the corpus teaches


@query(r"""SELECT word, n_dot, n_bare, round(2 * (n_dot * ln(CAST(0.99 AS DOUBLE)) + n_bare * ln(CAST(0.01 AS DOUBLE)) - n_dot * ln(p) - n_bare * ln(greatest(1 - p, 1e-12))) * exp(-letters) * (len(word) - letters + 1) * pow(letters, -least(n_bare, 300)), 4) + 0.0 AS score
FROM (SELECT *, CAST(len(replace(word, '.', '')) AS DOUBLE) AS letters, sum(n_dot) OVER () / CAST(sum(n_dot + n_bare) OVER () AS DOUBLE) AS p FROM (SELECT word, count(*) FILTER (WHERE dot) AS n_dot, count(*) FILTER (WHERE NOT dot) AS n_bare FROM
(SELECT regexp_replace(w, '\.$', '') AS word, ends_with(w, '.') AS dot FROM (SELECT unnest(regexp_extract_all(lower(text), '[^ \t\n\x0B\f\r]+')) AS w FROM documents)) WHERE regexp_matches(word, '^\p{L}[\p{L}.]*$') GROUP BY word)) WHERE n_dot > 0""")
def abbreviation_scores(a: Archive) -> DataFrame:
    """How well every word of the corpus and a period fit together."""
    return learned.abbreviation_scores(a.raw("documents")).withColumn("score", F.round("score", 4) + F.lit(0.0))


@query(r"""SELECT a, b, count(*) FILTER (WHERE NOT spaced) AS n_joined, count(*) FILTER (WHERE spaced) AS n_spaced FROM (SELECT c AS a, CASE WHEN next = ' ' THEN after ELSE next END AS b, next = ' ' AS spaced FROM (SELECT c, lead(c) OVER w AS next, lead(c, 2) OVER w AS after
FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY i))) WHERE NOT regexp_matches(a, '[ \t\n\x0B\f\r]') AND b IS NOT NULL AND NOT regexp_matches(b, '[ \t\n\x0B\f\r]') GROUP BY a, b""")
def spacing_pairs(a: Archive) -> DataFrame:
    """What the spacing model counts: pairs of characters that are joined, or parted by a blank."""
    return learned.fit_spacing(a.raw("documents"))


@query("SELECT doc_id, n AS n_copies, n AS n_found FROM (SELECT d.doc_id, (SELECT count(*) FROM documents o WHERE lower(o.text) = lower(d.text) AND o.doc_id <> d.doc_id) AS n FROM documents d WHERE d.doc_id % 100 = 0 AND regexp_matches(lower(coalesce(d.text, '')), '[\\p{L}\\p{N}_]'))")
def copies_by_vector(a: Archive) -> DataFrame:
    """Of every hundredth document: its copies, and how many of them the trained vectors bring within a hair's breadth."""
    docs = a.raw("documents").select("doc_id", F.sha2(F.lower("text").cast("binary"), 256).alias("digest"), "text")
    model = learned.fit_embedder(docs)
    vectors_ = saved(learned.embedded(docs.select("doc_id", "digest", "text"), F.col("text"), model).select(F.col("doc_id").alias("id"), "digest", "embedding"), "vectors")
    index = neighbours.build(vectors_.select("id", "embedding"), [])
    asked = vectors_.where("id % 100 = 0 AND exists(embedding, x -> x <> 0)")
    counts = vectors_.groupBy("digest").count()
    most = asked.join(counts, "digest").agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    # equal vectors lie in one cell, so the nearest is enough
    near = neighbours.approximate(asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), index, [], int(most) + 20, 1).where("distance < 1e-6 AND query_id <> id")
    equal = near.join(vectors_.select("id", "digest"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("digest").alias("own")), "query_id").where("digest = own").groupBy("query_id").agg(F.count("*").alias("n_found"))
    held = asked.join(counts, "digest").select(F.col("id").alias("doc_id"), (F.col("count") - 1).alias("n_copies"))
    return held.join(equal, held["doc_id"] == equal["query_id"], "left").select("doc_id", "n_copies", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"))


# ---------------------------------------------------------------- files, arguments, codes


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 'unsupported format' WHEN strlen(coalesce(text, '')) * 1000 > 20971520 THEN 'too large' WHEN doc_id % 7 < 2 AND doc_id % 5 = 0 THEN 'invalid file' END AS error FROM documents")
def upload_gate(a: Archive) -> DataFrame:
    """Every document as an upload a thousand times its size: what the gate says of its name, size and bytes."""
    k = F.col("doc_id")
    name = F.concat(F.lit("f."), F.element_at(F.lit(["txt", "MD", "png", "JPG", "jpeg", "Pdf", "docx"]), (k % 7 + 1).cast("int")))
    content = F.when(k % 5 == 0, F.unhex(F.lit("C328"))).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    return a.raw("documents").select("doc_id", files.upload_error(name, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") * 1000, content).alias("error"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 - 2 <= 0 THEN 'size must be positive' WHEN doc_id % 5 - 1 < 0 OR doc_id % 5 - 1 >= doc_id % 7 - 2 THEN 'overlap must be between 0 and size - 1' END AS problem FROM documents")
def chunk_arguments(a: Archive) -> DataFrame:
    k = F.col("doc_id")
    return a.raw("documents").select("doc_id", chunking.argument_problem(k % 7 - 2, k % 5 - 1).alias("problem"))


@query("SELECT doc_id, true AS formed FROM documents")
def admin_codes(a: Archive) -> DataFrame:
    """Random codes of administrators: their form, for every document."""
    return a.raw("documents").select("doc_id", text.admin_code().alias("code")).select("doc_id", F.col("code").rlike("^[0-9a-f]{12}$").alias("formed"))


@query("SELECT lang, doc_id, nth, last FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY lang) AS last FROM documents)")
def array_files(a: Archive) -> DataFrame:
    """Every language's documents written as an array of JSON in order, read back: the place of each, and how many there are."""
    base = fresh_path(a.spark, "arrays")
    docs = a.raw("documents").select("doc_id", "lang")
    names = [r[0] for r in docs.select("lang").distinct().collect()]  # a split has a file of its own
    out = []
    for i, lang in enumerate(names):
        files.write_array(docs.where(F.col("lang").eqNullSafe(F.lit(lang))), f"{base}/{i}", ["doc_id"])
        whole = a.spark.read.text(f"{base}/{i}", wholetext=True).select(F.from_json("value", "array<struct<doc_id:long,lang:string>>").alias("x"))
        out.append(whole.select(F.posexplode("x").alias("at", "r"), F.size("x").cast("long").alias("last")).select("r.lang", "r.doc_id", (F.col("at") + 1).cast("long").alias("nth"), "last"))
    return reduce(DataFrame.unionByName, out)
