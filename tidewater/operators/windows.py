"""Ordered operators on the indexed long frame. Each partitions by series, so series run side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import by_series


def select_window(df: DataFrame, start, end) -> DataFrame:
    """Rows with start <= ts <= end; the predicate reaches the scan."""
    return df.where(F.col("ts").between(F.lit(start), F.lit(end)))


def resample(df: DataFrame, factor: int, how: str = "mean") -> DataFrame:
    """Blocks of `factor` rows, stamped by their last time; an incomplete last block is left out."""
    value = {"mean": F.avg("value"), "sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"), "last": F.max_by("value", "idx")}[how]
    block = F.floor(F.col("idx") / factor).cast("long")
    out = df.groupBy("series", block.alias("idx")).agg(F.max("ts").alias("ts"), value.alias("value"), F.count("*").alias("n"))
    return out.where(F.col("n") == factor).drop("n")


def difference(df: DataFrame, lag: int = 1) -> DataFrame:
    """x[i] - x[i - lag]; the first `lag` rows of a series have none and go."""
    if lag < 1:
        raise ValueError("lag must be at least 1")
    d = F.col("value") - F.lag("value", lag).over(by_series("idx"))
    return df.withColumn("value", d).where(F.col("value").isNotNull())


def rolling_median_residual(df: DataFrame, season: int = 1) -> DataFrame:
    """value minus the centred rolling median; the window is made odd and clipped at the ends."""
    half = (season if season >= 5 else 5) // 2
    w = by_series("idx").rowsBetween(-half, half)
    return df.withColumn("residual", F.col("value") - F.percentile("value", F.lit(0.5)).over(w))


def phase_profile(df: DataFrame, season: int) -> DataFrame:
    """Mean and median of every phase of the season."""
    return df.groupBy("series", (F.col("idx") % season).alias("phase")).agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.count("*").alias("n"))


def split_scan(df: DataFrame, min_segment: int = 4) -> DataFrame:
    """For every series the split whose two means explain most: split, gain, and the means before and after.

    One running pass over prefix sums: no row is compared with another.
    """
    w = by_series("idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("series")
    n, total = F.count("*").over(whole), F.sum("value").over(whole)
    k, part = F.col("idx") + 1, F.sum("value").over(w)
    p = df.select("series", "idx", k.alias("k"), part.alias("a"), n.alias("n"), total.alias("t"))
    p = p.where((F.col("k") >= min_segment) & (F.col("n") - F.col("k") >= min_segment))
    rest = F.col("n") - F.col("k")
    gain = F.col("a") * F.col("a") / F.col("k") + (F.col("t") - F.col("a")) * (F.col("t") - F.col("a")) / rest - F.col("t") * F.col("t") / F.col("n")
    p = p.withColumn("gain", gain).withColumn("before", F.col("a") / F.col("k")).withColumn("after", (F.col("t") - F.col("a")) / rest)
    best = F.max_by(F.struct("k", "gain", "before", "after"), F.struct("gain", -F.col("k")))
    return p.groupBy("series").agg(best.alias("b")).select("series", F.col("b.k").alias("split"), F.col("b.gain").alias("gain"), F.col("b.before").alias("before"), F.col("b.after").alias("after"))


def autocorrelation(df: DataFrame, max_lag: int) -> DataFrame:
    """(series, lag, acf) of the values less their line, for lags 1 to max_lag, from one pass of lags over the window."""
    fit = df.groupBy("series").agg(F.regr_slope("value", "idx").alias("b"), F.regr_intercept("value", "idx").alias("a"))
    r = df.join(fit, "series").withColumn("r", F.col("value") - F.col("a") - F.col("b") * F.col("idx"))
    lags = r.select("series", "r", *[F.lag("r", k).over(by_series("idx")).alias(f"l{k}") for k in range(1, max_lag + 1)])
    sums = lags.groupBy("series").agg(F.sum(F.col("r") * F.col("r")).alias("d"), *[F.sum(F.col("r") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"s{k}").alias("s")) for k in range(1, max_lag + 1)]))
    return sums.select("series", "d", pairs.alias("p")).select("series", F.col("p.lag").alias("lag"), F.when(F.col("d") > 1e-12, F.col("p.s") / F.col("d")).alias("acf"))


def decompose(df: DataFrame, period: int) -> DataFrame:
    """Additive parts: trend (centred moving average, null at the ends), seasonal (phase means, centred), residual."""
    left, right = (period - 1) // 2, period // 2
    w = by_series("idx").rowsBetween(-left, right)
    t = df.withColumn("trend", F.when(F.count("*").over(w) == period, F.avg("value").over(w))).withColumn("detrended", F.col("value") - F.col("trend"))
    phase = t.groupBy("series", (F.col("idx") % period).alias("phase")).agg(F.avg("detrended").alias("raw"))
    mean = phase.groupBy("series").agg(F.avg("raw").alias("centre"))
    phase = phase.join(mean, "series").select("series", "phase", (F.col("raw") - F.col("centre")).alias("seasonal"))
    out = t.withColumn("phase", F.col("idx") % period).join(phase, ["series", "phase"])
    return out.withColumn("residual", F.col("detrended") - F.col("seasonal")).drop("phase")


def runs(df: DataFrame, active: str) -> DataFrame:
    """Maximal stretches of consecutive active rows: first and last idx, and how many."""
    on = df.where(F.col(active))
    island = F.col("idx") - F.row_number().over(by_series("idx"))
    return on.withColumn("island", island).groupBy("series", "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).drop("island")
