"""Bounds stated in words: what a span of text says a value will not leave, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)"
# Phrases of bounds. A phrase that is found is taken out of the text before the next kind is looked for, so that
# "no more than 60" is not also read as "more than 60", nor "not below 5" as "below 5".
BETWEEN = rf"(?i)\b(?:between|from)\s+{NUMBER}\s+(?:and|to)\s+{NUMBER}"
NOT_BELOW = rf"(?i)\b(?:not|never|n't)\s+(?:\w+\s+){{0,2}}?(?:below|under|less than|fewer than)\s+{NUMBER}"
NOT_ABOVE = rf"(?i)\b(?:not|never|n't)\s+(?:\w+\s+){{0,2}}?(?:above|over|exceed|more than|greater than)\s+{NUMBER}"
AT_MOST = rf"(?i)\b(?:at most|no more than|up to|maximum of|capped at|below|under|less than|fewer than)\s+{NUMBER}"
AT_LEAST = rf"(?i)\b(?:at least|no less than|no fewer than|minimum of|above|over|more than|greater than)\s+{NUMBER}"
FLOOR = r"(?i)\bnon-?negative\b|\b(?:cannot|can't|never|not)\s+(?:be|go|become)\s+negative\b|\b(?:are|is|remains?|stays?)\s+(?:always\s+)?(?:strictly\s+)?positive\b"


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_replace(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), ",", "").try_cast("double")


def bounds(span: Column) -> Column:
    """struct<minimum, maximum, problem>: what a span states; every number is one of the span's own.

    A range gives both; else each side is the first phrase of its kind, negated ones first. Without any, or with an empty
    range, `problem` says so.
    """
    text = F.trim(F.regexp_replace(span, r"\s+", " "))
    a, b = _number(text, BETWEEN, 1), _number(text, BETWEEN, 2)
    ranged = a.isNotNull() & b.isNotNull()
    left = F.regexp_replace(text, BETWEEN, " ")
    low, left = _number(left, NOT_BELOW), F.regexp_replace(left, NOT_BELOW, " ")
    high, left = _number(left, NOT_ABOVE), F.regexp_replace(left, NOT_ABOVE, " ")
    high, left = F.coalesce(high, _number(left, AT_MOST)), F.regexp_replace(left, AT_MOST, " ")
    low = F.coalesce(low, _number(left, AT_LEAST), F.when(text.rlike(FLOOR), 0.0))
    low, high = F.when(ranged, F.least(a, b)).otherwise(low), F.when(ranged, F.greatest(a, b)).otherwise(high)
    problem = F.when(low.isNull() & high.isNull(), "no bound is stated").when(low > high, "the bound is empty")
    return F.struct(low.alias("minimum"), high.alias("maximum"), problem.alias("problem"))


def times_of(span: Column) -> Column:
    """The multiple that a span like "3 times the usual level", "double" or "half" states."""
    said = F.regexp_extract(span, rf"(?i){NUMBER}\s*(?:x|times)\b", 1)
    word = F.when(span.rlike(r"(?i)\b(?:double|twice)"), 2.0).when(span.rlike(r"(?i)\b(?:triple|threefold)"), 3.0).when(span.rlike(r"(?i)\b(?:half|halve)"), 0.5)
    return F.coalesce(F.nullif(said, F.lit("")).try_cast("double"), word)


def schedule(text: Column) -> Column:
    """array<struct<date, value>>: the rows `YYYY-MM-DD: number` that a document states literally."""
    pattern = rf"([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\s*[:=,]\s*{NUMBER}"
    days, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(days, values, lambda d, v: F.struct(d.try_cast("date").alias("date"), F.regexp_replace(v, ",", "").try_cast("double").alias("value")))
