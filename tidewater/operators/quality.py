"""Grids: frequency, gaps, duplicates, fills and regrids. Every repair says on which rows it worked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import by_series


def infer_step(df: DataFrame) -> DataFrame:
    """The most frequent step in seconds of each series; of equally frequent ones the one seen first."""
    prev = F.lag("ts").over(by_series("ts"))
    step = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(prev.cast("timestamp"))).cast("long")
    d = df.withColumn("step", step).where(F.col("step").isNotNull())
    counts = d.groupBy("series", "step").agg(F.count("*").alias("n"), F.min("ts").alias("seen"))
    order = Window.partitionBy("series").orderBy(F.col("n").desc(), "seen")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").select("series", F.col("step").alias("step_seconds"), "n")


def gaps(df: DataFrame, step_seconds: int) -> DataFrame:
    """The holes in a regular grid: the times around each and how many rows are missing."""
    nxt = F.lead("ts").over(by_series("ts"))
    d = df.withColumn("next_ts", nxt).where(F.col("next_ts").isNotNull())
    wide = (F.unix_timestamp(F.col("next_ts").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))).cast("long")
    d = d.withColumn("missing", F.floor(wide / step_seconds).cast("long") - 1)
    return d.where("missing > 0").select("series", "ts", "next_ts", "missing")


def collapse_duplicates(df: DataFrame, order: str = "file_row_no") -> DataFrame:
    """One row for each (series, ts): the last in file order, and how many rows and distinct values there were."""
    return df.groupBy("series", "ts").agg(F.max_by("value", order).alias("value"), F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def fill_linear(df: DataFrame, step_days: int = 1) -> DataFrame:
    """Inner gaps of a daily grid by linear interpolation; `filled` marks what was added."""
    w = by_series("ts")
    d = df.withColumn("next_ts", F.lead("ts").over(w)).withColumn("next_value", F.lead("value").over(w))
    steps = F.coalesce(F.datediff("next_ts", "ts"), F.lit(step_days))
    d = d.withColumn("steps", (steps / step_days).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.col("steps") - 1, F.lit(0)))))
    value = F.when(F.col("k") == 0, F.col("value")).otherwise(F.col("value") + (F.col("next_value") - F.col("value")) * F.col("k") / F.col("steps"))
    return d.select("series", F.date_add("ts", F.col("k") * step_days).alias("ts"), value.alias("value"), (F.col("k") > 0).alias("filled"))


def regrid_daily(df: DataFrame, max_run: int = 10) -> DataFrame:
    """A calendar-daily grid by carrying values forward over up to max_run days; `filled` marks them."""
    d = df.withColumn("next_ts", F.lead("ts").over(by_series("ts")))
    run = F.least(F.coalesce(F.datediff("next_ts", "ts") - 1, F.lit(0)), F.lit(max_run))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), run)))
    return d.select("series", F.date_add("ts", F.col("k")).alias("ts"), "value", (F.col("k") > 0).alias("filled"))


def regrid_month_start(df: DataFrame) -> DataFrame:
    """Restamped to the first of the month; `conflict` marks months of more than one row, the last of which stays."""
    month = F.trunc("ts", "month")
    return df.groupBy("series", month.alias("ts")).agg(F.max_by("value", "ts").alias("value"), (F.count("*") > 1).alias("conflict"))


def snap(df: DataFrame, unit_seconds: int) -> DataFrame:
    """Times rounded half up to a unit; of rows that meet the later wins."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    at = F.timestamp_seconds(F.floor(seconds / unit_seconds + F.lit(0.5)) * unit_seconds).cast("timestamp_ntz")
    return df.groupBy("series", at.alias("snapped")).agg(F.max_by("value", "ts").alias("value"), F.count("*").alias("n"))


def out_of_order(df: DataFrame, order: str = "file_row_no") -> DataFrame:
    """How many rows of each series stand, in file order, where they would not stand by time."""
    a = F.row_number().over(Window.partitionBy("series").orderBy(order))
    b = F.row_number().over(Window.partitionBy("series").orderBy("ts", order))
    return df.withColumn("a", a).withColumn("b", b).groupBy("series").agg(F.count_if(F.col("a") != F.col("b")).alias("moved"))


def named_step(df: DataFrame) -> DataFrame:
    """(series, frequency, problem): the grid's code, or why there is none.

    MS where all times are firsts of a month at one time of day and single months are most of the steps; else the most
    frequent step if it is one of s, min, 5min, 15min, 30min, h, D or W; else the step of a series with one spacing, in whole
    seconds under a day.
    """
    w = by_series("ts")
    d = df.select("series", "ts").distinct()
    at = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    d = d.withColumn("prev", F.lag("ts").over(w)).withColumn("step", (at("ts") - at("prev")).cast("long"))
    months = (F.year("ts") - F.year("prev")) * 12 + F.month("ts") - F.month("prev")
    clock = F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss.SSSSSS")
    a = d.groupBy("series").agg(F.count("*").alias("n"), F.bool_and(F.dayofmonth("ts") == 1).alias("firsts"), F.count_distinct(clock).alias("clocks"), F.count_if(months == 1).alias("single"), F.count("step").alias("steps"), F.count_distinct("step").alias("kinds"))
    x = a.join(infer_step(df.select("series", "ts").distinct().withColumn("value", F.lit(0.0))).select("series", "step_seconds"), "series", "left")
    named = F.coalesce(*[F.when(F.col("step_seconds") == k, v) for k, v in NAMED.items()])
    odd = F.when((F.col("kinds") == 1) & (F.col("step_seconds") > 0) & (F.col("step_seconds") < 86400), canonical_code(F.col("step_seconds")))
    monthly = F.col("firsts") & (F.col("clocks") == 1) & (F.col("single") * 2 > F.col("steps"))
    code = F.when(F.col("n") < 3, None).when(monthly, "MS").otherwise(F.coalesce(named, odd))
    problem = F.when(F.col("n") < 3, "at least three times are needed").when(code.isNull() & (F.col("kinds") == 1), "the step is no supported grid").when(code.isNull(), "the spacing varies")
    return x.select("series", code.alias("frequency"), problem.alias("problem"))


# Steps in seconds that have a name: fixed values.
NAMED = {1: "s", 60: "min", 300: "5min", 900: "15min", 1800: "30min", 3600: "h", 86400: "D", 604800: "W"}
# Spellings of frequencies: fixed values.
ALIASES = {"H": "h", "hour": "h", "hourly": "h", "1h": "h", "day": "D", "daily": "D", "1d": "D", "1D": "D", "week": "W", "weekly": "W", "1w": "W", "month": "MS", "monthly": "MS", "M": "MS", "1M": "MS", "S": "s", "1s": "s", "sec": "s", "second": "s", "T": "min", "1T": "min", "1min": "min", "minute": "min", "1m": "min"}


def canonical_code(seconds):
    """The one spelling of a step under a day: <N>h, <N>min or <N>s."""
    s = seconds.cast("long")
    text = lambda n, u: F.concat(n.cast("long").cast("string"), F.lit(u))
    return F.when(s % 3600 == 0, text(s / 3600, "h")).when(s % 60 == 0, text(s / 60, "min")).otherwise(text(s, "s"))


def normalise_frequency(code: str) -> str:
    """The code of any of its spellings; other codes of whole seconds stay as they are."""
    found = ALIASES.get(code, code)
    if found in (*NAMED.values(), "MS") or re.fullmatch(r"[1-9]\d*(s|min|h)", found):
        return found
    raise ValueError(f"UNSUPPORTED_FREQUENCY: {code}")


def day_first(df: DataFrame, column: str) -> bool | None:
    """Whether dates like 13/06/2026 in a text column put the day first; null without evidence; refused if they disagree."""
    pattern = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}"
    part = lambda i: F.regexp_extract(column, pattern, i).try_cast("int") > 12
    d, m = df.agg(F.bool_or(part(1)), F.bool_or(part(2))).first()
    if d and m:
        raise ValueError("AMBIGUOUS_DATE_ORDER: the column mixes day-first and month-first dates")
    return True if d else False if m else None


def repaired(df: DataFrame, level: str = "safe", order: str = "file_row_no") -> tuple[DataFrame, DataFrame]:
    """Rows (series, ts, value) after the duplicates are repaired, and a log (series, code, count, assumptive).

    off changes nothing; safe collapses rows that repeat series, time and value; aggressive also lets the last row in file
    order win where values differ.
    """
    if level not in ("off", "safe", "aggressive"):
        raise ValueError("level is off, safe or aggressive")
    a = df.groupBy("series", "ts").agg(F.count("*").alias("n"), F.count_distinct("value").alias("k"), F.max_by("value", order).alias("value"))
    entry = lambda count, code, assumptive: a.groupBy("series").agg(F.sum(count).alias("count")).where("count > 0").select("series", F.lit(code).alias("code"), "count", F.lit(assumptive).alias("assumptive"))
    log = entry(F.col("n") - F.col("k"), "duplicate_row_collapsed", False)
    if level == "off":
        return df.select("series", "ts", "value"), log.where("false")
    if level == "safe":
        return df.select("series", "ts", "value").distinct(), log
    return a.select("series", "ts", "value"), log.unionByName(entry(F.col("k") - 1, "conflicting_duplicate_resolved", True))


def fill_refusals(df: DataFrame, most_share: float = 0.3) -> DataFrame:
    """(series, n, longest, filled, problem) of a daily grid: gaps that no repair may fill.

    A run of more than max(3, n / 10) days, or fills of more than `most_share` of the rows, hide that data is missing.
    """
    d = df.withColumn("_m", F.datediff(F.lead("ts").over(by_series("ts")), "ts") - 1)
    a = d.groupBy("series").agg(F.count("*").alias("n"), F.coalesce(F.max("_m"), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.when(F.col("_m") > 0, F.col("_m"))), F.lit(0)).alias("filled"))
    problem = F.when(F.col("longest") > F.greatest(F.lit(3), F.floor(F.col("n") / 10)), "gap_run").when(F.col("filled") / F.col("n") > most_share, "filled_share")
    return a.withColumn("problem", problem)


def regrid_refusals(df: DataFrame, max_run: int = 10, max_share: float = 0.45) -> DataFrame:
    """(series, longest, filled, share, problem) of carrying a business-day series onto calendar days."""
    d = df.withColumn("_m", F.datediff(F.lead("ts").over(by_series("ts")), "ts") - 1)
    clocks = F.count_distinct(F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss.SSSSSS"))
    a = d.groupBy("series").agg(F.count("*").alias("n"), clocks.alias("clocks"), F.coalesce(F.max("_m"), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.when(F.col("_m") > 0, F.col("_m"))), F.lit(0)).alias("filled"))
    share = F.col("filled") / (F.col("n") + F.col("filled"))
    problem = F.when(F.col("clocks") > 1, "distinct_times").when(F.col("longest") > max_run, "fill_run").when(share > max_share, "fill_share")
    return a.select("series", "longest", "filled", share.alias("share"), problem.alias("problem"))


def month_conflicts(df: DataFrame) -> DataFrame:
    """(series, ts, n): months that hold more than one row, which a monthly grid refuses."""
    return df.groupBy("series", F.trunc("ts", "month").alias("ts")).agg(F.count("*").alias("n")).where("n > 1")


def grid_problems(df: DataFrame, frequency: str) -> DataFrame:
    """(series, ts, next_ts, problem): for every series the first place where it leaves its grid.

    duplicate, irregular or weekend (only Saturdays and Sundays are missing from a daily grid).
    """
    nxt = F.lead("ts").over(by_series("ts"))
    d = df.withColumn("next_ts", nxt).where(F.col("next_ts").isNotNull())
    days = F.datediff("next_ts", "ts")
    if frequency == "MS":
        ok = F.col("next_ts") == F.add_months("ts", 1)
    elif frequency in ("D", "W"):
        ok = days == (7 if frequency == "W" else 1)
    else:
        step = {v: k for k, v in NAMED.items()}.get(frequency) or int(re.match(r"\d+", frequency)[0]) * {"s": 1, "min": 60, "h": 3600}[re.sub(r"\d", "", frequency)]
        ok = F.unix_timestamp(F.col("next_ts").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp")) == step
    weekend = (F.lit(frequency) == "D") & (F.dayofweek("ts") == 6) & (days == 3)
    kind = F.when(F.col("ts") == F.col("next_ts"), "duplicate").when(weekend, "weekend").otherwise("irregular")
    bad = d.where(~ok).withColumn("problem", kind)
    # A weekend only counts where nothing else is wrong before it.
    return bad.groupBy("series").agg(F.min_by(F.struct("ts", "next_ts", "problem"), F.struct((F.col("problem") == "weekend").cast("int"), "ts")).alias("p")).select("series", "p.*")


def coerced(df: DataFrame, column: str, out: str = "ts") -> DataFrame:
    """Text times with and without an offset on one clock, UTC: `out` without zone, and `assumed`, whether UTC was assumed."""
    offset = F.col(column).rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    text = F.when(offset, F.col(column)).otherwise(F.concat(column, F.lit("Z")))
    # As seconds since the epoch, so that the session's zone does not matter.
    instant = F.unix_micros(text.try_cast("timestamp"))
    naive = F.timestamp_add("MICROSECOND", instant, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return df.withColumn(out, naive).withColumn("assumed", ~offset)
