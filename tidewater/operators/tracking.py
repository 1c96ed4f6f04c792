"""Scores of past forecasts against what came true."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score(forecasts: DataFrame, actuals: DataFrame, naive: DataFrame) -> DataFrame:
    """Of (forecast_id, series, ts, point, low, high), (series, ts, actual) and (series, naive_error): metrics.

    A forecast is scored only once every step of it has its actual value.
    """
    j = forecasts.join(actuals, ["series", "ts"], "left")
    e = F.abs(F.col("actual") - F.col("point"))
    some = F.abs("actual") > 1e-9
    out = j.groupBy("forecast_id", "series").agg(
        F.avg(e).alias("mae"),
        F.avg(F.when(some, e / F.abs("actual") * 100)).alias("mape"),
        F.avg(F.col("point") - F.col("actual")).alias("bias"),
        F.avg(((F.col("actual") >= F.col("low")) & (F.col("actual") <= F.col("high"))).cast("int")).alias("coverage"),
        F.count("*").alias("steps"),
        F.count("actual").alias("known"),
    )
    out = out.where("steps = known").join(naive, "series", "left")
    return out.withColumn("mase", F.when(F.col("naive_error") > 1e-12, F.col("mae") / F.col("naive_error"))).drop("known")


def leaderboard(scores: DataFrame) -> DataFrame:
    """Means by model, and the latest MASE; models without one come last."""
    out = scores.groupBy("model").agg(F.avg("mase").alias("mase"), F.avg("mae").alias("mae"), F.avg("coverage").alias("coverage"), F.count("*").alias("n"), F.max_by("mase", F.struct("scored_at", "forecast_id")).alias("last_mase"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mase").asc_nulls_last(), "model")).cast("long"))


def drift_flags(scores: DataFrame, window: int = 5, keys: tuple[str, ...] = ("project", "model", "series", "horizon", "frequency")) -> DataFrame:
    """Each score against the median of the `window` scores before it of the same keys (those that `scores` has): over 50 %
    worse is degraded, over 25 % a warning. With fewer scores before, or a median of 0, there is no flag but `stable`."""
    held = [k for k in keys if k in scores.columns]
    own = scores.where("mase is not null")
    w = Window.partitionBy(*held).orderBy("scored_at").rowsBetween(-window, -1)
    usual = F.when(F.count("mase").over(w) == window, F.percentile("mase", F.lit(0.5)).over(w))
    out = own.withColumn("usual", F.when(usual > 0, usual))
    worse = F.col("mase") / F.col("usual") - 1
    return out.withColumn("drift", F.when(worse > 0.5, "degraded").when(worse > 0.25, "warning").otherwise("stable"))


def adapted_alpha(coverage: DataFrame, target: float = 0.8, rate: float = 0.02, low: float = 0.01, high: float = 0.5) -> DataFrame:
    """The miss rate after each outcome of (series, at, covered), a fold in order of time with its bounds."""
    seq = coverage.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("at", F.col("covered").cast("double").alias("c")))).alias("s"))
    start = 1 - target
    step = lambda a, x: F.greatest(F.lit(low), F.least(F.lit(high), a + rate * (start - (1 - x["c"]))))
    return seq.select("series", F.aggregate("s", F.lit(start), step).alias("alpha"), F.size("s").cast("long").alias("n"))


def proposer_skill(outcomes: DataFrame, shrink: int = 10) -> DataFrame:
    """Of (proposer, lift, hit): means shrunk towards no skill by `shrink` imagined outcomes."""
    out = outcomes.groupBy("proposer").agg(F.count("*").alias("n"), F.sum("lift").alias("s"), F.sum(F.col("hit").cast("int")).alias("hits"))
    return out.select("proposer", "n", (F.col("s") / (F.col("n") + shrink)).alias("lift"), ((F.col("hits") + shrink / 2) / (F.col("n") + shrink)).alias("hit_rate"))


def effect_prior(effects: DataFrame, shrink: int = 3, least: int = 5) -> DataFrame:
    """Of (event_type, effect): the pooled effect, shrunk, where it would have helped: leaving each one out, the mean of
    the others must miss it by less than no effect would."""
    w = Window.partitionBy("event_type")
    n, s = F.count("*").over(w), F.sum("effect").over(w)
    out = effects.withColumn("n", n).withColumn("others", F.when(n > 1, (s - F.col("effect")) / (n - 1)))
    out = out.groupBy("event_type").agg(F.max("n").alias("n"), F.sum("effect").alias("s"), F.avg(F.abs(F.col("effect") - F.col("others"))).alias("err"), F.avg(F.abs("effect")).alias("zero"))
    usable = (F.col("n") >= least) & (F.col("err") < F.col("zero"))
    return out.select("event_type", "n", (F.col("s") / (F.col("n") + shrink)).alias("effect"), F.coalesce(usable, F.lit(False)).alias("usable"))
