"""Feature prompts and evaluations, case by case."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import feature_prompts
from quillspark.operators import evaluation
from quillspark.plans import training

ARTICLE = "한빛시는 {title} 버스 120대를 바꾼다."


def told(spark, column):
    return [(m.role, m.content) for m in spark.range(1).select(column.alias("m")).head().m]


def test_training_prompts_are_those_of_the_features(spark):
    text, ask = F.lit(ARTICLE), F.lit("몇 대를 바꿔?")
    prompt, completion = training.summary_example(text, F.lit("요약"))
    assert told(spark, prompt) == told(spark, feature_prompts.messages("summary", passage=text)) == [("user", feature_prompts.SUMMARY.replace("{passage}", ARTICLE))]
    assert told(spark, completion) == [("assistant", "요약")]
    prompt, completion = training.answer_example(text, ask, F.lit(None).cast("string"))
    assert told(spark, prompt) == told(spark, feature_prompts.messages("qa", context=text, question=ask))
    assert told(spark, prompt)[0][1].endswith(f"뉴스 본문:\n{ARTICLE}\n\n질문:\n몇 대를 바꿔?")
    assert told(spark, completion) == [("assistant", "")]


def test_every_feature(spark):
    places = ("article", "template", "title", "description", "similar", "question", "passage", "context")
    shots = {"formatted_article": 1, "evaluation_item": 3, "article_metadata": 1, "duplicate_check": 3}
    assert len(feature_prompts.FEATURES) == 11
    for name, f in feature_prompts.FEATURES.items():
        got = told(spark, feature_prompts.messages(name, **{p: F.lit(f"<{p}>") for p in places}))
        roles = ([] if f.system is None else ["system"]) + ["user", "assistant"] * shots.get(name, 0) + ["user"]
        assert [r for r, _ in got] == roles
        assert all("{" not in c for _, c in got)
        # worked examples are worded like the question
        user = [c for r, c in got if r == "user"]
        assert all(c.split("\n")[-1] == user[-1].split("\n")[-1] for c in user)
    category = told(spark, feature_prompts.messages("category", article=F.lit("x")))[-1][1]
    assert "목록: 정치, 경제, 사회, 문화(생활 포함), IT," in category
    with pytest.raises(ValueError, match="article"):
        feature_prompts.messages("titles")


def test_evaluation_from_items_to_message(spark):
    articles = spark.createDataFrame([(1, 7, "본문"), (2, 7, None), (3, 8, "x"), (4, None, "y")], "article_id long, organization_id long, body string")
    guidelines = spark.createDataFrame([(5, 7, "지침", "1. 제목: 짧게\n- 숫자를 쓴다"), (6, 7, " 하나 ", " 설명 "), (9, 9, "a", "b")], "id long, organization_id long, title string, content string")
    assert [tuple(r) for r in evaluation.items_of(guidelines).where("organization_id = 7").orderBy("guideline_id", "item").collect()] == [(7, 5, 0, "제목", "짧게"), (7, 5, 1, "숫자를 쓴다", ""), (7, 6, 0, "하나", "설명")]
    asked = evaluation.asked(articles, guidelines)
    assert asked.count() == 6 and {r.article_id for r in asked.collect()} == {1, 2}
    assert asked.where("article_id = 1 AND item = 1").head().messages[-1].content.startswith("기사:\n본문\n\n작성 기준: 숫자를 쓴다\n기준 설명: \n")
    answers = {(1, 0): "<think>.</think>판정: 충족\n이유: 짧다", (1, 1): "미흡", (1, 2): "모름", (2, 0): None, (2, 1): "판정 : 해당  없음", (2, 2): "판정: 충족"}
    said = spark.createDataFrame([(a, 5 + i // 2, i % 2, raw) for (a, i), raw in answers.items()], "article_id long, guideline_id long, item int, raw string")
    verdicts = evaluation.graded(asked, lambda q: q.join(said, ["article_id", "guideline_id", "item"]))
    got = {r.article_id: r for r in evaluation.evaluated(verdicts).collect()}
    assert (got[1].met, got[1].short, got[1].none, got[1].failed) == (1, 1, 0, 1)
    assert got[1].message == "충족 1개, 미흡 1개, 해당 없음 0개, 판정 실패 1개\n\n[충족] 제목\n- 이유: 짧다\n\n[미흡] 숫자를 쓴다\n\n[판정 실패] 하나\n- 이유: 모름"
    assert got[2].message.startswith("충족 1개, 미흡 0개, 해당 없음 1개, 판정 실패 1개\n\n[판정 실패] 제목\n\n[해당 없음]")
    assert evaluation.evaluated(evaluation.graded(evaluation.asked(articles.limit(0), guidelines), lambda q: q.withColumn("raw", F.lit("")))).count() == 0
