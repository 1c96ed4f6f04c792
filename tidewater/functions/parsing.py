"""Lenient cells: numbers and times from messy text, with a tier that says how much was assumed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that mean "no value": fixed values, compared in lower case.
MISSING = ("", "na", "n/a", "n.a.", "nan", "null", "none", "nil", "-", "--", "missing", "?", "#n/a", "#value!", "#ref!", "#div/0!")
CURRENCY = r"[$€£¥₹]"
PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Written forms of times that are read: fixed values.
TIMES = ("yyyy/MM/dd", "yyyy/MM/dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "d-MMMM-yyyy")


def parse_number(cell: Column, comma: Column | str | None = None) -> Column:
    """struct<value, tier>: clean, normalised, assumptive, missing or error.

    comma: what a column's other cells show a comma to be, "thousands" or "decimal"; unknown, `1,234` is taken as
    thousands, an assumption.
    """
    comma = F.lit(comma).cast("string") if comma is None or isinstance(comma, str) else comma
    raw = F.trim(F.coalesce(cell.cast("string"), F.lit("")))
    negative = raw.rlike(r"^\(.*\)$")
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\((.*)\)$", "$1"), rf"{CURRENCY}|%|\s", ""))
    thousands = bare.rlike(r"^[+-]?\d{1,3}(,\d{3})+\.\d+$") | bare.rlike(r"^[+-]?\d{1,3}(,\d{3}){2,}$")
    european = bare.rlike(r"^[+-]?\d{1,3}(\.\d{3})+,\d+$")
    one = bare.rlike(r"^[+-]?\d{1,3},\d{3}$")
    decimal = bare.rlike(r"^[+-]?\d+,\d+$") & ~one
    no_comma, as_point = F.regexp_replace(bare, ",", ""), F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")
    one_decimal = F.coalesce(comma == "decimal", F.lit(False))
    text = F.when(thousands, no_comma).when(european | decimal, as_point).when(one & one_decimal, as_point).when(one, no_comma).otherwise(bare)
    number = F.when(text.rlike(PLAIN), text.try_cast("double")) * F.when(negative, -1.0).otherwise(1.0)
    missing = F.lower(raw).isin(*MISSING)
    tier = (
        F.when(missing, "missing")
        .when(number.isNull(), "error")
        .when(raw.rlike(PLAIN), "clean")
        .when(one & comma.isNull(), "assumptive")
        .otherwise("normalised")
    )
    return F.struct(F.when(~missing, number).alias("value"), tier.alias("tier"))


def comma_role(cell: Column) -> Column:
    """Over a column: "thousands", "decimal", or null where its cells show neither or both."""
    bare = F.regexp_replace(cell.cast("string"), rf"{CURRENCY}|%|\s", "")
    t = F.coalesce(F.bool_or(bare.rlike(r"^[+-]?\d{1,3}(,\d{3})+\.\d+$")), F.lit(False))
    d = F.coalesce(F.bool_or(bare.rlike(r"^[+-]?\d{1,3}(\.\d{3})+,\d+$") | (bare.rlike(r"^[+-]?\d+,\d+$") & ~bare.rlike(r"^[+-]?\d{1,3},\d{3}$"))), F.lit(False))
    return F.when(t & ~d, "thousands").when(d & ~t, "decimal")


def parse_time(cell: Column, day_first: Column | bool | None = None) -> Column:
    """A time without zone, in UTC, or null: ISO, epoch seconds or milliseconds, and common written forms.

    `05/06/2026` needs day_first to be known; where one part is over 12 it decides itself.
    """
    s = F.trim(cell.cast("string"))
    known = F.lit(day_first).cast("boolean") if day_first is None or isinstance(day_first, bool) else day_first
    first = F.regexp_extract(s, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}", 1).try_cast("int")
    second = F.regexp_extract(s, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}", 2).try_cast("int")
    day = F.when(first > 12, True).when(second > 12, False).otherwise(known)
    parts = F.regexp_replace(s, r"[.-]", "/")
    ambiguous = F.when(day, F.try_to_timestamp(parts, F.lit("d/M/yyyy"))).when(~day, F.try_to_timestamp(parts, F.lit("M/d/yyyy")))
    epoch = F.when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(s.try_cast("long"))).when(s.rlike(r"^\d{13}$"), F.timestamp_millis(s.try_cast("long")))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}"), s.try_cast("timestamp"))
    forms = [F.when(s.rlike(r"[/,A-Za-z -]") | s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit(f))) for f in TIMES]
    return F.coalesce(epoch, iso, F.when(first.isNotNull(), ambiguous), *forms).cast("timestamp_ntz")
