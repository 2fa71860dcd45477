"""Prompts as columns: templates with named places, examples and messages. The wording is a parameter."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE = "array<struct<role:string,content:string>>"


def rendered(template: str, /, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by its column; null is the empty text. Braces inside values stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    missing = set(parts[1::2]) - values.keys()
    if missing:
        raise ValueError(f"no value for {', '.join(sorted(missing))}")
    return F.concat(*[F.coalesce(values[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: str, user: Column, shots: Sequence[tuple[str, str]] = (), history: Column | None = None, last: int = 10) -> Column:
    """System message, worked examples, the ``last`` messages of the history, then the user's message."""
    fixed = [message("system", F.lit(system))] + [message(r, F.lit(t)) for pair in shots for r, t in zip(("user", "assistant"), pair, strict=True)]
    held = F.array(*fixed).cast(MESSAGE)
    if history is not None:
        held = F.concat(held, recent(F.coalesce(history.cast(MESSAGE), F.array().cast(MESSAGE)), last))
    return F.concat(held, F.array(message("user", user)).cast(MESSAGE))


def recent(history: Column, last: int = 10) -> Column:
    """The last messages of an array, oldest first."""
    n = F.size(history)
    return F.slice(history, F.greatest(n - last + 1, F.lit(1)), F.lit(last))


def training_pair(system: str, user: Column, answer: Column) -> tuple[Column, Column]:
    """(prompt, completion), worded as at inference."""
    return chat(system, user).alias("prompt"), F.array(message("assistant", answer)).alias("completion")
