"""Articles against their organisation's guidelines, from the items of a guideline to the message and the tally of verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import feature_prompts, parsers
from quillspark.functions.text import let, strip

from .company import evaluation_text


def items_of(guidelines: DataFrame) -> DataFrame:
    """(organization_id, guideline_id, item, title, description) of guidelines (organization_id, id, title, content): one item a line, numbered from
    0 in each guideline. A null title or content is empty; a guideline without lines is one item by its title."""
    held = parsers.guideline_items(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return guidelines.select("organization_id", F.col("id").alias("guideline_id"), F.posexplode(held).alias("item", "x")).select("organization_id", "guideline_id", "item", "x.title", "x.description")


def asked(articles: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Every article (article_id, organization_id, body) beside every item of its organisation's guidelines, with the prompt's messages. Articles of
    organisations without guidelines, and those without organisation, have no row; a null body is an empty one."""
    held = articles.join(items_of(guidelines), "organization_id")
    return held.withColumn("messages", feature_prompts.messages("evaluation_item", article=F.col("body"), title=F.col("title"), description=F.col("description")))


def graded(questions: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(article_id, guideline_id, item, title, verdict, reason): what the model (``answer`` adds a column raw) says, parsed. Null answers fail."""
    said = let(strip(parsers.without_thoughts(F.coalesce("raw", F.lit("")))), parsers.verdict)  # the answer is built and tidied once
    return answer(questions).select("article_id", "guideline_id", "item", "title", said.alias("said")).select("article_id", "guideline_id", "item", "title", "said.verdict", "said.reason")


def evaluated(verdicts: DataFrame) -> DataFrame:
    """(article_id, met, short, none, failed, message): the tally and the text of each article's evaluation, by guideline and item."""
    order = F.array_sort(F.collect_list(F.struct("guideline_id", "item", "title", "verdict", "reason")))  # the items of one organisation's guidelines
    rows = verdicts.groupBy("article_id").agg(order.alias("items"))
    n = lambda v: F.size(F.filter("items", lambda i: i["verdict"] == v)).cast("long")
    tally = [n(v).alias(c) for c, v in zip(("met", "short", "none", "failed"), parsers.VERDICTS, strict=True)]
    return rows.select("article_id", *tally, parsers.message_text(evaluation_text(F.col("items"))).alias("message"))
