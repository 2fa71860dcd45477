"""Slots for models, with deterministic stand-ins of built-in functions: embeddings and generated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let


def embed(text: Column, size: int = 64) -> Column:
    """A hashed bag of words of length 1, as an array of floats; zeros for a text without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    counted = lambda slots: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    long = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda m, x: m + x * x))
    scaled = lambda raw: let(long(raw), lambda n: F.transform(raw, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))
    return let(let(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size))), counted), scaled)


def answered(prompts: DataFrame, canned: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Answers from a table (prompt_hash, answer); a prompt without one gets null."""
    return prompts.withColumn("prompt_hash", F.sha2(F.col(prompt).cast("binary"), 256)).join(canned, "prompt_hash", "left").drop("prompt_hash")


def messages(**parts: Column) -> Column:
    """A chat prompt: parts by role, in the order given."""
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in parts.items()])


def recognised(pages: DataFrame, known: DataFrame, image: str = "image", kind: str = "blocks") -> DataFrame:
    """What a layout or text-recognition model says of page images, from a table (image_hash, ``kind``); an image without an
    entry gets null. The slot's model writes that table; an image is read once, however many pages show it."""
    return pages.withColumn("image_hash", F.sha2(F.col(image), 256)).join(known.select("image_hash", kind), "image_hash", "left").drop("image_hash")
