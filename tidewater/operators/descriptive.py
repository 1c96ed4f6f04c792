"""What happened: anomalies, changes, seasons, and how series move together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import by_series, indexed, materialised
from ..functions.stats import MAD_SCALE, TINY, guarded_corr, with_robust_scale
from . import windows

THRESHOLD = 3.5


def anomaly_score(df: DataFrame, season: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Robust z of every row, to four digits: the value less its phase's median, in units of 1.4826 MAD over all phases.

    A series of fewer than two seasons has one median. Fewer than 8 rows are too few: z is null and nothing is anomalous.
    """
    whole, half = Window.partitionBy("series"), F.lit(0.5)
    d = df.withColumn("_n", F.count("*").over(whole))
    d = d.withColumn("phase", F.when(F.col("_n") >= 2 * season, F.col("idx") % season).otherwise(0))
    d = d.withColumn("_a", F.col("value") - F.percentile("value", half).over(Window.partitionBy("series", "phase")))
    d = d.withColumn("_c", F.percentile("_a", half).over(whole)).withColumn("_m", F.percentile(F.abs(F.col("_a") - F.col("_c")), half).over(whole))
    z = F.when(F.col("_n") >= 8, F.round(F.col("_a") / F.greatest(F.col("_m") * MAD_SCALE, F.lit(TINY)), 4))
    return d.withColumn("z", z).withColumn("anomalous", F.coalesce(F.abs("z") >= threshold, F.lit(False))).drop("_n", "_a", "_c", "_m")


def penalties(df: DataFrame, sensitivity: float) -> DataFrame:
    """(series, n, sse, penalty): sens * 2 * noise^2 * sqrt(n), the noise being 1.4826 MAD of the differences."""
    noise = with_robust_scale(windows.difference(df), fallback=False).select("series", "scale")
    n = df.groupBy("series").agg(F.count("*").alias("n"), (F.var_pop("value") * F.count("*")).alias("sse"))
    return n.join(noise, "series").select("series", "n", "sse", (F.lit(2.0 * sensitivity) * F.col("scale") * F.col("scale") * F.sqrt("n")).alias("penalty"))


def changepoint(df: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """The best mean shift of each series, and whether its gain exceeds the penalty on 12 rows at least."""
    out = windows.split_scan(df).join(penalties(df, sensitivity), "series")
    out = out.withColumn("detected", (F.col("n") >= 12) & (F.col("gain") > F.col("penalty")))
    return out.withColumn("relative_gain", F.when(F.col("sse") > 1e-12, F.col("gain") / F.col("sse"))).drop("penalty")


def changepoints(df: DataFrame, sensitivity: float = 1.0, most: int = 3, min_segment: int = 4) -> DataFrame:
    """Binary segmentation: up to `most` splits (series, split, ts, before_mean, after_mean, shift, relative_gain).

    Each round takes, of the best splits of all segments of a series, the one of the largest gain over the penalty. Means
    are of the 12 rows before and after.
    """
    limit = materialised(penalties(df, sensitivity).where("n >= 12"))
    rows, found = df.select("series", "idx", "value").withColumn("seg", F.lit(0).cast("long")), None
    for _ in range(most):
        part = Window.partitionBy("series", "seg")
        w = part.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        # Sums of values less their segment's mean: a large mean would take the digits of the squares.
        p = rows.withColumn("x", F.col("value") - F.avg("value").over(part)).withColumn("a", F.sum("x").over(w)).withColumn("m", F.count("*").over(part)).withColumn("k", F.col("idx") - F.col("seg") + 1)
        p = p.where((F.col("k") >= min_segment) & (F.col("m") - F.col("k") >= min_segment))
        p = p.withColumn("gain", F.col("a") * F.col("a") * (1 / F.col("k") + 1 / (F.col("m") - F.col("k"))))
        best = p.groupBy("series").agg(F.max_by(F.struct("seg", (F.col("idx") + 1).alias("split"), "gain"), F.struct("gain", -F.col("idx"))).alias("b"))
        best = materialised(best.select("series", "b.*").join(limit, "series").where("gain > penalty").select("series", F.col("seg").alias("of"), "split", "gain", "sse"))
        found = best if found is None else found.unionByName(best)
        cut = best.select("series", "of", F.col("split").alias("at"))
        rows = rows.join(F.broadcast(cut) if best.count() <= 100_000 else cut, "series", "left").withColumn("seg", F.when((F.col("seg") == F.col("of")) & (F.col("idx") >= F.col("at")), F.col("at")).otherwise(F.col("seg"))).drop("of", "at")
    near = df.join(found, "series").where((F.col("idx") >= F.col("split") - 12) & (F.col("idx") < F.col("split") + 12))
    late = F.col("idx") >= F.col("split")
    out = near.groupBy("series", "split").agg(
        F.min(F.when(late, F.col("ts"))).alias("ts"),
        F.avg(F.when(~late, F.col("value"))).alias("before_mean"),
        F.avg(F.when(late, F.col("value"))).alias("after_mean"),
        F.first(F.col("gain") / (F.col("sse") + TINY)).alias("relative_gain"),
    )
    return out.withColumn("shift", F.col("after_mean") - F.col("before_mean"))


def regimes(df: DataFrame, splits: DataFrame, persist: int = 5, back: int = 24) -> DataFrame:
    """(series, split, post, standardised, tail, regime) of splits (series, split).

    The shift of the 12 rows on either side, and that of what follows the first persist - 1 rows after, in 1.4826 MAD of the
    `back` rows before: reverted, where the second is under half of the first and under 1, is a transient anomaly. Fewer than
    `persist` rows after the split leave it undetermined.
    """
    d = df.select("series", "idx", "value").join(splits.select("series", "split"), "series")
    d = d.where(F.col("idx") >= F.col("split") - back).withColumn("off", F.col("idx") - F.col("split"))
    pre = F.when(F.col("off") < 0, F.col("value"))
    key = ["series", "split"]
    centre = d.groupBy(*key).agg(F.percentile(pre, F.lit(0.5)).alias("_c"))
    d = d.join(centre, key)
    a = d.groupBy(*key).agg(
        F.percentile(F.when(F.col("off") < 0, F.abs(F.col("value") - F.col("_c"))), F.lit(0.5)).alias("mad"),
        F.avg(pre).alias("pre"),
        F.avg(F.when((F.col("off") < 0) & (F.col("off") >= -12), F.col("value"))).alias("before"),
        F.avg(F.when((F.col("off") >= 0) & (F.col("off") < 12), F.col("value"))).alias("after"),
        F.avg(F.when(F.col("off") >= persist - 1, F.col("value"))).alias("late"),
        F.count_if(F.col("off") >= 0).alias("post"),
    )
    scale = F.greatest(F.col("mad") * MAD_SCALE, F.lit(TINY))
    a = a.withColumn("standardised", F.abs(F.col("after") - F.col("before")) / scale).withColumn("tail", F.abs(F.col("late") - F.col("pre")) / scale)
    kind = F.when(F.col("post") < persist, "undetermined").when(F.col("tail") < F.greatest(F.lit(1.0), F.col("standardised") / 2), "transient_anomaly").otherwise("regime_shift")
    return a.select("series", "split", "post", "standardised", "tail", kind.alias("regime"))


def regime(df: DataFrame, cp: DataFrame, width: int = 5) -> DataFrame:
    """(series, post, regime) of the detected split of each series."""
    return regimes(df, cp.where("detected"), width).select("series", "post", "regime")


def seasonality(df: DataFrame, period: int) -> DataFrame:
    """Strength of the season: 1 - var(residual) / var(detrended), at least 0."""
    d = windows.decompose(df, period).where(F.col("trend").isNotNull())
    out = d.groupBy("series").agg(F.var_pop("residual").alias("r"), F.var_pop("detrended").alias("d"))
    return out.select("series", F.when(F.col("d") > 1e-12, F.greatest(F.lit(0.0), 1 - F.col("r") / F.col("d"))).alias("strength"))


def cross_correlation(df: DataFrame, left: str, right: str, lags: int = 8) -> DataFrame:
    """r of the differences of two series at lags -lags to lags; `significant` beyond 2 / sqrt(n - 1)."""
    d = windows.difference(df)
    x = d.where(F.col("series") == left).select("idx", F.col("value").alias("x"))
    y = d.where(F.col("series") == right).select("idx", F.col("value").alias("y"))
    shifted = x.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("at", F.col("idx") + F.col("lag"))
    both = shifted.join(y.withColumnRenamed("idx", "at"), "at")
    out = both.groupBy("lag").agg(guarded_corr("x", "y").alias("r"), F.count("*").alias("n"))
    return out.withColumn("significant", F.coalesce(F.abs("r") >= F.lit(2.0) / F.sqrt(F.col("n") - 1), F.lit(False)))


def correlations(df: DataFrame) -> DataFrame:
    """Pearson's r of every pair of series over their common times, from one pass over each time's values."""
    at = df.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("series", "value"))).alias("v"))
    a = at.select("v", F.posexplode("v").alias("i", "a"))
    b = a.select("a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))
    flat = b.select(F.col("a.series").alias("series_a"), F.col("b.series").alias("series_b"), F.col("a.value").alias("x"), F.col("b.value").alias("y"))
    return flat.groupBy("series_a", "series_b").agg(guarded_corr("x", "y").alias("r"), F.count("*").alias("n"))


def event_study(df: DataFrame, events: DataFrame, width: int = 7) -> DataFrame:
    """Mean of the width rows before and after each event (series, event_id, at), and their difference, also in 1.4826 MAD
    of the rows before.

    An event at no row's time takes the place after the last row before it. All is null where either side has too few rows.
    """
    e = events.join(df.select("series", "ts", "idx"), "series").where(F.col("ts") <= F.col("at")).groupBy("series", "event_id").agg((F.max("idx") + F.when(F.max_by("ts", "idx") == F.first("at"), 0).otherwise(1)).alias("at_idx"))
    d = df.join(e, "series").where((F.col("idx") >= F.col("at_idx") - width) & (F.col("idx") < F.col("at_idx") + width))
    pre, post = F.when(F.col("idx") < F.col("at_idx"), F.col("value")), F.when(F.col("idx") >= F.col("at_idx"), F.col("value"))
    key = ["series", "event_id"]
    d = d.withColumn("_c", F.percentile(pre, F.lit(0.5)).over(Window.partitionBy(*key)))
    out = d.groupBy(*key).agg(F.avg(pre).alias("before"), F.avg(post).alias("after"), F.percentile(F.when(pre.isNotNull(), F.abs(F.col("value") - F.col("_c"))), F.lit(0.5)).alias("mad"), F.count(pre).alias("n1"), F.count(post).alias("n2"))
    whole = (F.col("n1") == width) & (F.col("n2") == width)
    effect = F.col("after") - F.col("before")
    standardised = F.round(effect / F.greatest(F.col("mad") * MAD_SCALE, F.lit(TINY)), 4)
    found = out.select(*key, *[F.when(whole, x).alias(n) for n, x in (("before", F.col("before")), ("after", F.col("after")), ("effect", effect), ("standardised", standardised))])
    return events.select(*key).join(found, key, "left")


def stationarity(df: DataFrame) -> DataFrame:
    """Dickey-Fuller with a constant: the t value of the slope of differences on levels; stationary under -2.86."""
    w = by_series("idx")
    d = df.withColumn("x", F.lag("value").over(w)).withColumn("y", F.col("value") - F.col("x")).where(F.col("x").isNotNull())
    s = d.groupBy("series").agg(F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.count("*").alias("n"))
    rss = F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(rss / (F.col("n") - 2) / F.col("sxx"))
    return s.where(F.col("n") >= 12).select("series", F.when(se > 1e-12, F.col("b") / se).alias("t")).withColumn("stationary", F.col("t") < -2.86)


def profile(df: DataFrame) -> DataFrame:
    """A summary of each series: size, level, spread, trend, reversals and zeros."""
    w = by_series("idx")
    d = df.withColumn("d", F.col("value") - F.lag("value").over(w))
    d = d.withColumn("turn", (F.col("d") * F.lag("d").over(w) < 0).cast("int"))
    return d.groupBy("series").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.regr_slope("value", "idx").alias("slope"),
        F.avg("turn").alias("reversal_rate"),
        F.avg((F.col("value") == 0).cast("int")).alias("zero_share"),
    )


def compare_windows(df: DataFrame, width: int) -> DataFrame:
    """The last `width` rows against those before them: means, spreads and their differences."""
    n = F.count("*").over(Window.partitionBy("series"))
    d = df.withColumn("n", n).where(F.col("idx") >= F.col("n") - 2 * width)
    late = F.col("idx") >= F.col("n") - width
    side = lambda f, on: f(F.when(on, F.col("value")))
    out = d.groupBy("series").agg(side(F.avg, late).alias("mean_late"), side(F.avg, ~late).alias("mean_early"), side(F.stddev_samp, late).alias("sd_late"), side(F.stddev_samp, ~late).alias("sd_early"))
    return out.withColumn("change", F.col("mean_late") - F.col("mean_early")).withColumn("sd_ratio", F.when(F.col("sd_early") > 1e-12, F.col("sd_late") / F.col("sd_early")))


def analogues(df: DataFrame, width: int, k: int = 5) -> DataFrame:
    """The k past blocks of `width` rows nearest to the last, by mean, spread and slope, each in units of its deviation."""
    n = F.count("*").over(Window.partitionBy("series"))
    d = df.withColumn("n", n).withColumn("block", F.floor((F.col("n") - 1 - F.col("idx")) / width).cast("long"))
    f = d.groupBy("series", "block").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.regr_slope("value", "idx").alias("b"), F.count("*").alias("c")).where(F.col("c") == width)
    over = Window.partitionBy("series")
    unit = lambda c: F.greatest(F.stddev_pop(c).over(over), F.lit(1e-12))
    f = f.select("series", "block", *[(F.col(c) / unit(c)).alias(c) for c in ("m", "s", "b")])
    now = f.where("block = 0").select("series", *[F.col(c).alias(f"{c}0") for c in ("m", "s", "b")])
    gap = F.sqrt(sum((F.pow(F.col(c) - F.col(f"{c}0"), 2) for c in ("m", "s", "b")), F.lit(0.0)))
    near = f.where("block > 0").join(now, "series").withColumn("distance", gap)
    order = Window.partitionBy("series").orderBy("distance", "block")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("series", "rank", "block", "distance")


def rolling_median_scores(df: DataFrame, season: int = 1) -> DataFrame:
    """Rows with `score`: the residual against the centred rolling median in its 1.4826 MAD."""
    r = windows.rolling_median_residual(df, season)
    # The residuals' own median is left in, as they are centred already.
    s = with_robust_scale(r, "residual", fallback=False).select("series", "scale")
    return r.join(s, "series").withColumn("score", F.col("residual") / F.col("scale")).drop("residual", "scale")


def detect(df: DataFrame, season: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Two detectors side by side: phase-wise robust z and the rolling-median residual in its robust scale."""
    z = anomaly_score(df, season, threshold).select("series", "idx", "ts", "value", "z")
    r = windows.rolling_median_residual(indexed(df.drop("idx")) if "idx" not in df.columns else df, season)
    s = with_robust_scale(r, "residual").select("series", "scale")
    r = r.join(s, "series").select("series", "idx", F.when(F.col("scale") > 1e-12, F.col("residual") / F.col("scale")).otherwise(0.0).alias("rolling_z"))
    out = z.join(r, ["series", "idx"])
    return out.withColumn("votes", (F.abs("z") >= threshold).cast("int") + (F.abs("rolling_z") >= threshold).cast("int"))
