"""Evidence of change in observed windows: comparisons, votes over resolutions and series, seasons, and shape summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import by_series, histories
from ..functions.stats import MAD_SCALE, TINY, median, with_robust_scale
from . import windows

Z90 = 1.6448536269514722
PROPERTIES = ("level", "trend", "volatility", "regime", "extreme")
# Directions that say that nothing changed.
STILL = ("uncertain", "similar", "constant", "stable", "no_shift")


def local_slope_scores(df: DataFrame, season: int = 1, least: int = 9, most: int = 101) -> DataFrame:
    """Rows with `score`: the rolling median of first differences less their median, in 1.4826 MAD.

    The window grows with the series, n / 20 within [least, most], covers two seasons and is odd, so that few widths occur.
    The last row carries the score before it; fewer than three rows score 0.
    """
    whole = Window.partitionBy("series")
    n = F.count("*").over(whole)
    wide = F.greatest(F.lit(least), F.least(F.floor(F.col("_n") / 20), F.lit(most)))
    wide = F.greatest(wide, F.lit(2 * season + 1)) if season > 1 else wide
    wide = F.least(wide, F.greatest(F.lit(3), F.col("_n") - 1))
    d = df.withColumn("_n", n).withColumn("_h", F.floor((wide + F.when(wide % 2 == 0, 1).otherwise(0)) / 2).cast("int"))
    d = d.withColumn("_d", F.lead("value").over(by_series("idx")) - F.col("value"))
    out = None
    for (half,) in d.select("_h").distinct().orderBy("_h").collect():
        w = by_series("idx").rowsBetween(-half, half)
        part = d.where((F.col("_h") == half) & F.col("_d").isNotNull()).withColumn("_s", F.percentile("_d", F.lit(0.5)).over(w))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.withColumn("score", F.lit(0.0))
    s = with_robust_scale(out, "_s", fallback=False)
    scored = out.join(s, "series").select("series", "idx", ((F.col("_s") - F.col("med")) / F.col("scale")).alias("score"))
    out = df.join(scored, ["series", "idx"], "left").withColumn("_n", n)
    carried = F.coalesce("score", F.lag("score").over(by_series("idx")))
    return out.withColumn("score", F.when(F.col("_n") >= 3, carried).otherwise(0.0)).drop("_n")


def causal_residuals(df: DataFrame, season: int = 1) -> DataFrame:
    """Rows from idx max(3, season) on with `residual`: the value less what the rows before it say.

    That is the value one season before where two seasons are past, else the line through the ends of the last 8 rows.
    """
    w = by_series("idx")
    width = F.least(F.lit(8), F.col("idx"))
    first = F.when(F.col("idx") >= 8, F.lag("value", 8).over(w)).otherwise(F.first("value").over(w))
    last = F.lag("value").over(w)
    line = last + (last - first) / F.greatest(width - 1, F.lit(1))
    guess = F.when(F.col("idx") >= 2 * season, F.lag("value", season).over(w)).otherwise(line) if season > 1 else line
    return df.withColumn("residual", F.col("value") - guess).where(F.col("idx") >= max(3, season))


def detect_season(df: DataFrame, default: int = 1, cap: int = 366) -> DataFrame:
    """(series, period, strength, source): the first peak of the autocorrelation of the values less their line.

    A peak is a lag from 2 on, of at most half of the rows and max(2 default, cap), over max(0.3, 2 / sqrt(n)). Without one,
    or with fewer than 8 rows or none that vary, the period is the default.
    """
    fit = df.groupBy("series").agg(F.regr_slope("value", "idx").alias("b"), F.regr_intercept("value", "idx").alias("a"))
    r = df.join(fit, "series").select("series", "idx", (F.col("value") - F.coalesce(F.col("a") + F.col("b") * F.col("idx"), F.col("value"))).alias("value"))
    h = histories(r).withColumn("n", F.size("h"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    most = F.least(F.floor(F.col("n") / 2), F.lit(max(2 * default, cap))).cast("int")
    h = h.withColumn("d", total(F.transform("h", lambda v: v * v))).withColumn("most", most)
    dot = lambda k: total(F.zip_with(F.slice("h", F.lit(1), F.col("n") - k), F.slice("h", k + 1, F.col("n") - k), lambda x, y: x * y)) / F.col("d")
    able = (F.col("n") >= 8) & (F.col("d") > TINY) & (F.col("most") >= 1)
    h = h.withColumn("acf", F.when(able, F.transform(F.sequence(F.lit(1), F.greatest("most", F.lit(1))), dot)))
    high = F.greatest(F.lit(0.3), 2 / F.sqrt("n"))
    at = lambda k: F.get("acf", k - 1)
    peaks = F.filter(F.sequence(F.lit(2), F.greatest(F.col("most") - 1, F.lit(2))), lambda k: (k < F.col("most")) & (at(k) >= high) & (at(k) > at(k - 1)) & (at(k) >= at(k + 1)))
    h = h.withColumn("peak", F.get(peaks, F.lit(0)))
    found = F.col("peak").isNotNull()
    return h.select("series", F.coalesce("peak", F.lit(default)).cast("long").alias("period"), F.when(found, at(F.col("peak"))).otherwise(0.0).alias("strength"), F.when(found, "autocorrelation").otherwise("frequency_default").alias("source"))


def differenced(df: DataFrame, times: int = 0, period: int | None = None) -> DataFrame:
    """The rows differenced `times` times, then once by the period, with idx from 0 again."""
    for lag in [1] * times + ([period] if period else []):
        df = windows.difference(df, lag).withColumn("idx", F.col("idx") - lag)
    return df


def kpss(df: DataFrame) -> DataFrame:
    """(series, n, bandwidth, statistic, conclusion) of the KPSS test of a stationary level, on 12 rows at least."""
    whole = Window.partitionBy("series")
    d = df.withColumn("n", F.count("*").over(whole)).where("n >= 12").withColumn("e", F.col("value") - F.avg("value").over(whole))
    d = d.withColumn("c", F.sum("e").over(by_series("idx").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("bandwidth", F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(0.25)))).cast("int"))
    most = d.agg(F.max("bandwidth")).first()[0] or 0
    lags = [F.sum(F.col("e") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, most + 1)]
    d = d.select("*", *[F.lag("e", k).over(by_series("idx")).alias(f"l{k}") for k in range(1, most + 1)])
    a = d.groupBy("series", "n", "bandwidth").agg(F.sum(F.col("e") * F.col("e")).alias("g"), F.sum(F.col("c") * F.col("c")).alias("cc"), *lags)
    weigh = lambda k: F.when(F.lit(k) <= F.col("bandwidth"), 2 * (1 - F.lit(k) / (F.col("bandwidth") + 1)) * F.col(f"s{k}")).otherwise(0.0)
    long_run = (F.col("g") + sum((weigh(k) for k in range(1, most + 1)), F.lit(0.0))) / F.col("n")
    out = a.select("series", "n", F.col("bandwidth").cast("long").alias("bandwidth"), (F.col("cc") / (F.col("n") * F.col("n") * F.greatest(long_run, F.lit(TINY)))).alias("statistic"))
    return out.withColumn("conclusion", F.when(F.col("statistic") > 0.463, "nonstationary").otherwise("stationarity_not_rejected"))


def momentum(df: DataFrame) -> DataFrame:
    """(series, slope, persistent): the median slope of the log scales of overlapping recent windows (Theil-Sen)."""
    n = df.groupBy("series").agg(F.count("*").alias("n"))
    width = F.greatest(F.lit(24), F.least(F.lit(48), F.floor(F.col("n") / 5))).cast("int")
    n = n.withColumn("width", width).withColumn("step", F.greatest(F.lit(8), F.floor(F.col("width") / 2)).cast("int"))
    able = n.where(F.col("n") >= F.col("width") + 3 * F.col("step"))
    first = F.greatest(F.col("width").cast("long"), F.col("n") - 4 * F.col("step"))
    ends = able.select("series", "width", F.explode(F.sequence(first, F.col("n"), F.col("step").cast("long"))).alias("end"))
    rows = df.join(ends, "series").where((F.col("idx") >= F.col("end") - F.col("width")) & (F.col("idx") < F.col("end")))
    p = with_robust_scale(rows, keys=("series", "end")).select("series", "end", F.log(F.greatest("scale", F.lit(TINY))).alias("y"))
    seq = p.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("end", "y"))).alias("p"))
    pair = seq.select("series", "p", F.posexplode("p").alias("i", "a")).select("series", "p", "a", F.explode_outer(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b"))
    slope = median((F.col("b.y") - F.col("a.y")) / (F.col("b.end") - F.col("a.end")))
    steps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p")), lambda x, y: y["y"] - x["y"])
    out = pair.groupBy("series").agg(slope.alias("slope"), F.first("p").alias("p")).withColumn("steps", steps).withColumn("net", F.element_at("p", -1)["y"] - F.element_at("p", 1)["y"])
    agree = F.size(F.filter("steps", lambda x: x * F.col("net") > 0))
    out = out.select("series", "slope", ((F.abs("net") >= 0.15) & (agree >= 2)).alias("persistent"))
    return n.select("series").join(out, "series", "left").select("series", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("persistent", F.lit(False)).alias("persistent"))


def compared(df: DataFrame, season: int = 1, width: Column | None = None) -> DataFrame:
    """(series, width, property, estimate, low, high, direction): the last `width` rows against the `width` before.

    Level and trend are in units of the innovation scale (the robust scale of differences over sqrt 2), volatility is the
    ratio of the robust scales of what a line and the phases leave, extreme the change of the share beyond 3.5 scales, and
    regime the larger of level and trend; with 90 % intervals. width is a column of `n`, max(8, 2 season) by default; a
    series too short for it, or without dispersion in the window before, has no rows.
    """
    n = df.groupBy("series").agg(F.count("*").alias("n"))
    w = F.least(F.lit(max(8, 2 * season)) if width is None else width, F.floor(F.col("n") / 2)).cast("long")
    n = n.withColumn("width", w).where(F.col("width") >= max(6, season))
    unit = with_robust_scale(windows.difference(df)).select("series", F.greatest(F.col("scale") / F.sqrt(F.lit(2.0)), F.lit(TINY)).alias("unit"))
    d = df.join(n, "series").where(F.col("idx") >= F.col("n") - 2 * F.col("width"))
    d = d.withColumn("late", F.col("idx") >= F.col("n") - F.col("width"))
    d = d.withColumn("pos", F.col("idx") - F.when(F.col("late"), F.col("n") - F.col("width")).otherwise(F.col("n") - 2 * F.col("width")))
    key = ["series", "late"]
    lines = d.groupBy(*key).agg(F.regr_slope("value", "pos").alias("b"), F.regr_syy("value", "pos").alias("syy"), F.regr_sxx("value", "pos").alias("sxx"), F.regr_sxy("value", "pos").alias("sxy"), F.first("width").alias("width"))
    se = F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / (F.col("width") - 2) / F.col("sxx"))
    lines = lines.select(*key, "b", se.alias("b_se"))
    level = with_robust_scale(d, keys=tuple(key)).select(*key, F.col("med").alias("m"), F.col("scale").alias("s"))
    d = d.join(lines, key).withColumn("x", F.col("value") - F.col("b") * F.col("pos"))
    centre = F.percentile("x", F.lit(0.5)).over(Window.partitionBy(*key))
    if season > 1:
        centre = F.when(F.col("width") >= 2 * season, F.avg("x").over(Window.partitionBy(*key, F.col("pos") % season))).otherwise(centre)
    d = d.withColumn("r", F.col("x") - centre)
    rs = with_robust_scale(d, "r", keys=tuple(key)).select(*key, F.col("scale").alias("rs"))
    before = rs.where("not late").select("series", F.col("rs").alias("rs0"))
    far = d.join(before, "series").groupBy(*key).agg(F.count_if(F.abs("r") > 3.5 * F.greatest("rs0", F.lit(TINY))).alias("far"))
    side = lines.join(level, key).join(rs, key).join(far, key)
    cols = ["b", "b_se", "m", "s", "rs", "far"]
    both = side.where("late").select("series", *[F.col(c).alias(f"{c}1") for c in cols]).join(side.where("not late").select("series", *[F.col(c).alias(f"{c}0") for c in cols]), "series")
    x = both.join(n, "series").join(unit, "series").where("rs0 > 1e-12")
    c, nw = F.col, F.col("width").cast("double")
    x = x.withColumn("level", (c("m1") - c("m0")) / c("unit")).withColumn("level_se", 1.2533 * F.sqrt(c("s0") * c("s0") / nw + c("s1") * c("s1") / nw) / c("unit"))
    x = x.withColumn("trend", (c("b1") - c("b0")) / c("unit")).withColumn("trend_se", F.sqrt(c("b_se0") * c("b_se0") + c("b_se1") * c("b_se1")) / c("unit"))
    x = x.withColumn("ratio", c("rs1") / c("rs0")).withColumn("log_se", 1.64 * F.sqrt(1 / (nw - 1)))
    tail = lambda k: (c(k) + 0.5) / (nw + 1)
    x = x.withColumn("extreme", (c("far1") - c("far0")) / nw).withColumn("extreme_se", F.sqrt(tail("far0") * (1 - tail("far0")) / nw + tail("far1") * (1 - tail("far1")) / nw))
    ends = {p: (c(p) - Z90 * c(f"{p}_se"), c(p) + Z90 * c(f"{p}_se")) for p in ("level", "trend", "extreme")}
    nearest = lambda p: F.when(ends[p][0] * ends[p][1] > 0, F.least(F.abs(ends[p][0]), F.abs(ends[p][1]))).otherwise(0.0)
    strength = F.greatest(F.abs("level"), F.abs("trend"))

    def three(value: Column, over: float, under: float, labels: tuple[str, str, str]) -> Column:
        return F.when(value > over, labels[0]).when(value < under, labels[1]).otherwise(labels[2])

    ratio_band = [F.when(c("ratio") > 0, F.exp(F.log("ratio") + z * c("log_se"))) for z in (-Z90, Z90)]
    rows = [
        ("level", c("level"), *ends["level"], three(c("level"), 0.25, -0.25, ("higher", "lower", "similar"))),
        ("trend", c("trend"), *ends["trend"], three(c("trend"), 0.02, -0.02, ("upward", "downward", "constant"))),
        ("volatility", c("ratio"), *ratio_band, three(c("ratio"), 1.25, 0.8, ("increased", "decreased", "stable"))),
        ("regime", strength, F.greatest(nearest("level"), nearest("trend")), F.greatest(*[F.abs(e) for p in ("level", "trend") for e in ends[p]]), F.when(strength >= 1, "shift").otherwise("no_shift")),
        ("extreme", c("extreme"), *ends["extreme"], three(c("extreme"), 0.02, -0.02, ("increased", "decreased", "stable"))),
    ]
    out = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), e.alias("estimate"), lo.alias("low"), hi.alias("high"), dr.alias("direction")) for p, e, lo, hi, dr in rows]))
    return x.select("series", "width", out.alias("r")).select("series", "width", "r.*")


def supported(rows: DataFrame) -> DataFrame:
    """Rows of `compared` with `support`: supported where the estimate is clear of its threshold or the interval within it."""
    c, size = F.col, F.abs("estimate")
    inside = lambda a, b: (c("low") >= a) & (c("high") <= b)
    still = c("direction").isin(*STILL)
    clear = (
        F.when(c("property") == "level", F.when(still, inside(-0.25, 0.25)).otherwise(size >= 0.75))
        .when(c("property") == "trend", F.when(still, inside(-0.02, 0.02)).otherwise(size >= 0.06))
        .when(c("property") == "volatility", F.when(c("direction") == "increased", c("estimate") >= 1.5).when(c("direction") == "decreased", c("estimate") <= 0.67).otherwise(inside(0.8, 1.25)))
        .when(c("property") == "regime", F.when(still, c("high") < 1).otherwise((c("estimate") >= 1.5) & (c("low") >= 1)))
        .otherwise(F.when(still, inside(-0.01, 0.01)).otherwise((size >= 0.04) & ((c("low") > 0) | (c("high") < 0))))
    )
    return rows.withColumn("support", F.when(F.coalesce(clear, F.lit(False)), "supported").otherwise("weak"))


def multi_resolution(df: DataFrame, season: int = 1) -> DataFrame:
    """(series, property, direction, support, agreement, diverges, resolutions): a vote of up to four window widths.

    Widths that are the same for a series count once. A supported comparison weighs 2, a weak one 1.
    """
    half = F.floor(F.col("n") / 2)
    widths = [F.lit(max(8, season)), F.lit(max(16, 2 * season)), F.lit(max(24, 4 * season)), F.greatest(F.lit(32), F.least(half, F.lit(8 * season)))]
    rows = None
    for w in widths:
        part = supported(compared(df, season, w))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.dropDuplicates(["series", "width", "property"])
    votes = rows.groupBy("series", "property", "direction").agg(F.sum(F.when(F.col("support") == "supported", 2.0).otherwise(1.0)).alias("score"), F.count("*").alias("n"))
    out = votes.groupBy("series", "property").agg(F.min(F.struct((-F.col("score")).alias("s"), "direction")).alias("best"), F.sum("score").alias("total"), F.sum("n").alias("resolutions"), F.count("*").alias("c"))
    agreement, score = -F.col("best.s") / F.col("total"), -F.col("best.s")
    support = F.when((F.col("resolutions") >= 2) & (agreement >= 0.75) & (score >= 3), "supported").when(agreement > 0.5, "weak").otherwise("abstained")
    return out.select("series", "property", F.when(agreement > 0.5, F.col("best.direction")).otherwise("uncertain").alias("direction"), support.alias("support"), agreement.alias("agreement"), (F.col("c") > 1).alias("diverges"), "resolutions")


def hypotheses(resolutions: DataFrame, limit: int = 3) -> DataFrame:
    """(series, rank, property, direction, support, score): what changed most clearly, by weight of support and agreement."""
    weight = F.when(F.col("support") == "supported", 2.0).when(F.col("support") == "weak", 1.0).otherwise(0.0)
    x = resolutions.where(~F.col("direction").isin(*STILL)).withColumn("score", weight * F.col("agreement"))
    order = Window.partitionBy("series").orderBy(F.col("score").desc(), "property")
    return x.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select("series", "rank", "property", "direction", "support", "score")


def consensus(rows: DataFrame) -> DataFrame:
    """Of `compared`: (property, direction, support, effective_series, agreement, estimate), the vote of all series."""
    c = rows.groupBy("property", "direction").agg(F.count("*").alias("n"), median("estimate").alias("estimate"))
    out = c.groupBy("property").agg(F.max(F.struct("n", "direction", "estimate")).alias("b"), F.sum("n").alias("effective_series"))
    agreement = F.col("b.n") / F.col("effective_series")
    support = F.when((F.col("effective_series") >= 5) & (agreement >= 0.8), "supported").when(agreement > 0.5, "weak").otherwise("abstained")
    return out.select("property", F.when(agreement > 0.5, F.col("b.direction")).otherwise("uncertain").alias("direction"), support.alias("support"), "effective_series", agreement.alias("agreement"), F.col("b.estimate").alias("estimate"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(series, length, trend, noise_ratio, intermittency, direction_change_rate), unit-free; null under four rows."""
    w = by_series("idx")
    turns = df.withColumn("d", F.col("value") - F.lag("value").over(w)).withColumn("turn", F.col("d") * F.lag("d").over(w) < 0)
    a = turns.groupBy("series").agg(F.count("*").alias("length"), F.regr_slope("value", "idx").alias("b"), F.avg((F.col("value") == 0).cast("int")).alias("zeros"), F.count_if("turn").alias("turns"))
    x = a.join(with_robust_scale(df, fallback=False), "series")
    enough = F.col("length") >= 4
    of = lambda v: F.when(enough, F.round(v, 4))
    return x.select(
        "series",
        "length",
        of(F.col("b") / F.col("scale")).alias("trend"),
        of(F.when(F.abs("med") > TINY, F.col("scale") / F.abs("med"))).alias("noise_ratio"),
        of(F.col("zeros")).alias("intermittency"),
        of(F.col("turns") / F.greatest(F.col("length") - 2, F.lit(1))).alias("direction_change_rate"),
    )


SHAPE = ("trend", "noise_ratio", "intermittency", "direction_change_rate")


def fingerprint_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(series_a, series_b, distance) of all of a against all of b, a stated set of references, which is broadcast in size.

    Dimensions that either lacks are left out; the logarithm of the length counts as one more, if any is left.
    """
    left = a.select(F.col("series").alias("series_a"), *[F.col(c).alias(f"{c}_a") for c in ("length", *SHAPE)])
    right = b.select(F.col("series").alias("series_b"), *[F.col(c).alias(f"{c}_b") for c in ("length", *SHAPE)])
    squares = [F.pow(F.col(f"{c}_a") - F.col(f"{c}_b"), 2) for c in SHAPE]
    some = F.coalesce(*squares).isNotNull()
    total = sum((F.coalesce(s, F.lit(0.0)) for s in squares), F.pow(F.log10("length_a") - F.log10("length_b"), 2))
    return left.crossJoin(right).select("series_a", "series_b", F.when(some, F.round(F.sqrt(total), 4)).alias("distance"))


def regime_bins(df: DataFrame, horizon: int, season: int, frequency: str) -> DataFrame:
    """Six coarse descriptions of every series: frequency, history by horizon, season, trend, zeros and stability of scale."""
    w = by_series("idx")
    d = df.withColumn("n", F.count("*").over(Window.partitionBy("series"))).withColumn("d", F.abs(F.col("value") - F.lag("value").over(w)))
    d = d.withColumn("s", F.abs(F.col("value") - F.lag("value", season).over(w))).withColumn("early", F.col("idx") - 1 < F.floor((F.col("n") - 1) / 2))
    a = d.groupBy("series").agg(
        F.count("*").alias("n"),
        F.greatest(F.max("value") - F.min("value"), F.lit(TINY)).alias("span"),
        F.max_by("value", "idx").alias("last"),
        F.min_by("value", "idx").alias("first"),
        F.avg((F.abs("value") <= TINY).cast("int")).alias("zeros"),
        F.avg("d").alias("naive"),
        F.avg("s").alias("seasonal"),
        F.avg(F.when(F.col("early"), F.col("d"))).alias("left"),
        F.avg(F.when(~F.col("early"), F.col("d"))).alias("right"),
    )
    c = F.col
    ratio, trend = c("n") / horizon, F.abs((c("last") - c("first")) / F.greatest(c("n") - 1, F.lit(1))) / c("span")
    scale, relative = F.greatest("left", "right") / F.greatest(F.least("left", "right"), F.lit(TINY)), c("seasonal") / F.greatest("naive", F.lit(TINY))
    known = (F.lit(season) > 1) & (c("n") >= 2 * season)
    kind = "subdaily" if frequency.lower() in ("s", "min", "h") else "daily_weekly" if frequency.lower() in ("d", "w") else "monthly_or_slower"
    return a.select(
        "series",
        F.lit(kind).alias("frequency_class"),
        F.when(ratio < 1, "lt_1").when(ratio < 2, "1_to_2").when(ratio < 4, "2_to_4").otherwise("gte_4").alias("history_horizon_ratio"),
        F.when(~known, "unknown").when(relative < 0.6, "high").when(relative < 1, "moderate").otherwise("low").alias("seasonality_strength"),
        F.when(trend < 0.005, "low").when(trend < 0.02, "moderate").otherwise("high").alias("trend_strength"),
        F.when(c("zeros") >= 0.4, "high").when(c("zeros") >= 0.1, "moderate").otherwise("low").alias("intermittency"),
        F.when(c("n") < 5, "unknown").when(scale < 2, "stable").otherwise("changing").alias("scale_stability"),
    )


def label_grades(flags: DataFrame, labels: DataFrame, tolerance: int = 1) -> DataFrame:
    """Of flagged (series, idx) and labelled (series, idx): precision, recall and F1, within `tolerance` rows."""
    near = labels.select("series", F.col("idx").alias("label"), F.explode(F.sequence(F.col("idx") - tolerance, F.col("idx") + tolerance)).alias("idx"))
    hit = flags.join(near.select("series", "idx").distinct().withColumn("hit", F.lit(1)), ["series", "idx"], "left")
    p = hit.groupBy("series").agg(F.count("*").alias("flagged"), F.count("hit").alias("right"))
    found = near.join(flags.withColumn("f", F.lit(1)), ["series", "idx"], "left").groupBy("series", "label").agg(F.max("f").alias("f"))
    r = found.groupBy("series").agg(F.count("*").alias("labelled"), F.count("f").alias("found"))
    x = r.join(p, "series", "left").na.fill(0)
    precision, recall = F.coalesce(F.try_divide("right", "flagged"), F.lit(0.0)), F.col("found") / F.col("labelled")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return x.select("series", "flagged", "labelled", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def seasonal_envelope(df: DataFrame, season: int, probability: float = 0.9) -> DataFrame:
    """(series, phase, level): the interpolated quantile of each phase, for series of two whole seasons at least."""
    d = df.withColumn("_n", F.count("*").over(Window.partitionBy("series"))).where((F.col("_n") >= 2 * season) & (F.lit(season) >= 2))
    return d.groupBy("series", (F.col("idx") % season).alias("phase")).agg(F.percentile("value", F.lit(probability)).alias("level"))


def phase_trend(df: DataFrame, season: int) -> DataFrame:
    """(series, slope): the slope within phases, so that a part of a season is no trend; null for short series."""
    part = Window.partitionBy("series", F.col("idx") % max(1, season))
    d = df.withColumn("x", F.col("idx") - F.avg("idx").over(part)).withColumn("y", F.col("value") - F.avg("value").over(part))
    a = d.groupBy("series").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.count("*").alias("n"))
    return a.select("series", F.when((F.col("n") >= max(8, 2 * max(season, 1))) & (F.col("xx") > TINY), F.col("xy") / F.col("xx")).alias("slope"))


def innovation_scale(df: DataFrame) -> DataFrame:
    """(series, scale): 1.4826 MAD of the first differences; where it vanishes, the median of those that are not 0."""
    d = windows.difference(df)
    s = with_robust_scale(d).select("series", (F.col("mad") * MAD_SCALE).alias("a"))
    nz = d.groupBy("series").agg(F.count("*").alias("n"), median(F.when(F.col("value") != 0, F.abs("value"))).alias("b"))
    return s.join(nz, "series").select("series", F.when(F.col("n") >= 2, F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b"))).alias("scale"))


def future_grid(df: DataFrame, horizon: int, step: str) -> DataFrame:
    """(series, step, ts): the next `horizon` times of the grid; D, W and MS step by the calendar, <N>s, min and h by time."""
    last = df.groupBy("series").agg(F.max("ts").alias("last")).select("series", "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    if step == "MS":
        ts = F.add_months(F.trunc("last", "month"), F.col("step"))
    elif step in ("D", "W"):
        days = F.col("step") * (7 if step == "W" else 1)
        ts = F.date_add("last", days) if dict(df.dtypes)["ts"] == "date" else F.timestamp_add("DAY", days, F.col("last"))
    else:
        count, unit = int(step.rstrip("hmins") or 1), step.lstrip("0123456789")
        ts = F.timestamp_add({"s": "SECOND", "min": "MINUTE", "h": "HOUR"}[unit], F.col("step") * count, F.col("last"))
    return last.select("series", F.col("step").cast("long").alias("step"), ts.alias("ts"))
