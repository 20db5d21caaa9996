"""Text and period filters as Columns."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERMS = 6


def all_terms(column: Column, question: str, most: int = MAX_TERMS) -> Column:
    """Every one of the question's first words occurs, case-folded; words are literals, not patterns."""
    words = question.split()[:most]
    return reduce(lambda a, b: a & b, (F.contains(F.lower(column), F.lit(w.lower())) for w in words), F.lit(True))


def prefix(column: Column, start: str) -> Column:
    return F.startswith(column, F.lit(start))


def period(column: Column, preset: str, today: date, start: date | None = None, end: date | None = None) -> Column:
    """today, 7d, 30d, month, or custom (bounds swap if reversed); whole days, both ends included."""
    if preset == "today":
        start, end = today, today
    elif preset in ("7d", "30d"):
        start, end = today - timedelta(days=int(preset[:-1]) - 1), today
    elif preset == "month":
        start, end = today.replace(day=1), today
    if start and end and start > end:
        start, end = end, start
    out = F.lit(True)
    if start:
        out &= column >= F.lit(start.isoformat()).cast("timestamp")
    if end:
        out &= column < F.lit((end + timedelta(days=1)).isoformat()).cast("timestamp")
    return out


def plausible_year(column: Column, now: int, first: int = 2000, ahead: int = 2) -> Column:
    return column.between(first, now + ahead)
