"""Calendar periods and what a question says about period and category. Weeks start on Monday; times are local."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories, periods and their labels, keyword rules in order of precedence.
CATEGORIES = ("정치", "경제", "사회", "문화", "IT", "과학", "세계", "엔터테인먼트", "스포츠")
UNCATEGORIZED = "미분류"
PERIOD_LABELS = {
    "today": "오늘", "yesterday": "어제", "this_week": "이번 주", "last_week": "지난주", "this_month": "이번 달", "last_month": "지난달",
    "last_7_days": "최근 7일", "last_30_days": "최근 30일", "this_year": "올해", "all": "전체 기간",
}
PERIOD_WORDS = {
    "최근7일": "last_7_days", "최근일주일": "last_7_days", "최근30일": "last_30_days", "최근한달": "last_30_days", "오늘": "today", "어제": "yesterday",
    "지난주": "last_week", "저번주": "last_week", "이번주": "this_week", "금주": "this_week", "지난달": "last_month", "저번달": "last_month",
    "이번달": "this_month", "올해": "this_year", "금년": "this_year",
}


def bounds(period: str, now: datetime) -> tuple[datetime, datetime] | None:
    """[start, end) of a named period, by truncation and steps; None for ``all`` and unknown names."""
    day = datetime(now.year, now.month, now.day)
    week, month = day - timedelta(days=day.weekday()), day.replace(day=1)
    step = lambda d, n: datetime(d.year + (d.month - 1 + n) // 12, (d.month - 1 + n) % 12 + 1, 1)
    days = {"today": (0, 1), "yesterday": (-1, 0), "last_7_days": (-6, 1), "last_30_days": (-29, 1)}
    if period in days:
        a, b = days[period]
        return day + timedelta(days=a), day + timedelta(days=b)
    if period in ("this_week", "last_week"):
        start = week - timedelta(days=7 * (period == "last_week"))
        return start, start + timedelta(days=7)
    if period in ("this_month", "last_month"):
        n = -(period == "last_month")
        return step(month, n), step(month, n + 1)
    return (datetime(day.year, 1, 1), datetime(day.year + 1, 1, 1)) if period == "this_year" else None


def within(at: Column, period: str, now: datetime) -> Column:
    span = bounds(period, now)
    return F.lit(True) if span is None else (at >= F.lit(span[0]).cast("timestamp_ntz")) & (at < F.lit(span[1]).cast("timestamp_ntz"))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def first_match(tests: list[tuple[Column, object]], default: object) -> Column:
    out = None
    for test, value in tests:
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def period_of(question: Column) -> Column:
    text = compact(question)
    return first_match([(text.contains(w), p) for w, p in PERIOD_WORDS.items()], "all")


def category_of(question: Column) -> Column:
    inside = lambda c: question.rlike(r"(?i)(?<![A-Za-z])IT(?![A-Za-z])") if c == "IT" else question.contains(c)
    return first_match([(inside(c), c) for c in CATEGORIES], None)
