"""Backtests on rolling origins, model selection against baselines, and conformal intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import histories, materialised
from ..functions.stats import TINY, conformal_quantile, isotonic, pinball, wilson_upper
from .models import BASELINES, MODELS
from .recursive import RECURSIVE, with_predictions

MARGIN = 0.02
MAX_FIT = 2048
QUANTILES = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95)


def folds(df: DataFrame, horizon: int, season: int, max_fit: int = MAX_FIT) -> DataFrame:
    """(series, origin, role, h, actual): non-overlapping origins from max(2 season, 2 horizon, 8) on.

    With three origins or more the last but one calibrates and the last tests; with two the last calibrates. The values
    of a series are collected once and sliced for each fold, the last max(max_fit, 4 season) of them at most.
    """
    first, keep = max(2 * season, 2 * horizon, 8), max(max_fit, 4 * season)
    h = histories(df).withColumn("n", F.size("h")).where(F.col("n") - horizon >= first)
    f = h.withColumn("origins", F.sequence(F.lit(first), F.col("n") - horizon, F.lit(horizon)))
    f = f.select("series", "h", F.size("origins").alias("m"), F.posexplode("origins").alias("i", "origin"))
    left = F.col("m") - F.col("i")
    role = F.when((F.col("m") >= 3) & (left == 1), "test").when((F.col("m") >= 3) & (left == 2) | (F.col("m") == 2) & (left == 1), "calibrate").otherwise("select")
    start = F.greatest(F.lit(1), F.col("origin") - keep + 1)
    return f.select("series", F.col("origin").cast("long").alias("origin"), role.alias("role"), F.slice("h", start, F.col("origin") - start + 1).alias("past"), F.slice("h", F.col("origin") + 1, F.lit(horizon)).alias("actual"))


def backtest(df: DataFrame, horizon: int, season: int, models: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """(series, origin, role, model, lead, actual, predicted) of every model on every fold."""
    # The folds of one series spread over all tasks.
    f, slow = folds(df, horizon, season).repartition("series", "origin"), [m for m in models if m in RECURSIVE]
    if slow:
        f = with_predictions(f, slow, horizon, season)
    predicted = {m: F.col(f"p_{m}") if m in slow else MODELS[m](F.col("past"), horizon, season) for m in models}
    runs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), predicted[m].alias("p")) for m in models]))
    each = f.select("series", "origin", "role", "actual", runs.alias("r")).select("series", "origin", "role", F.col("r.model").alias("model"), F.posexplode(F.arrays_zip(F.col("actual").alias("a"), F.col("r.p").alias("p"))).alias("i", "x"))
    return each.select("series", "origin", "role", "model", (F.col("i") + 1).cast("long").alias("lead"), F.col("x.a").alias("actual"), F.col("x.p").alias("predicted"))


def fold_scores(bt: DataFrame) -> DataFrame:
    """WAPE of every model on every fold; null where a step has no prediction or the actual values vanish."""
    total = F.sum(F.abs("actual"))
    whole = F.count("predicted") == F.count("*")
    return bt.groupBy("series", "origin", "role", "model").agg(F.when((total > TINY) & whole, F.sum(F.abs(F.col("actual") - F.col("predicted"))) / total).alias("wape"))


def select_model(scores: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(series, model, score, baseline, baseline_score): the model that publishes.

    The strongest baseline stands unless the single best other model beats its mean WAPE by the margin and, on three
    folds or more, wins more than half of them with a positive median gain. A model must score on every selection fold.
    """
    s = scores.where("role = 'select'")
    mean = s.groupBy("series", "model").agg(F.avg("wape").alias("score"), F.count("wape").alias("c"), F.count("*").alias("n")).where("c = n")
    base = mean.where(F.col("model").isin(*BASELINES)).groupBy("series").agg(F.min(F.struct("score", "model")).alias("b"))
    other = mean.where(~F.col("model").isin(*BASELINES)).groupBy("series").agg(F.min(F.struct("score", "model")).alias("o"))
    best = base.join(other, "series", "left").select("series", F.col("b.model").alias("baseline"), F.col("b.score").alias("baseline_score"), F.col("o.model").alias("rival"), F.col("o.score").alias("rival_score"))
    paired = s.join(best.select("series", "baseline", "rival"), "series")
    w = paired.groupBy("series", "origin").agg(F.max(F.when(F.col("model") == F.col("baseline"), F.col("wape"))).alias("wb"), F.max(F.when(F.col("model") == F.col("rival"), F.col("wape"))).alias("wr"))
    gain = F.when(F.col("wb") > TINY, (F.col("wb") - F.col("wr")) / F.col("wb"))
    w = w.groupBy("series").agg(F.count("wr").alias("folds"), F.avg((F.col("wr") < F.col("wb")).cast("int")).alias("wins"), F.percentile(gain, F.lit(0.5)).alias("gain"))
    beats = (F.col("baseline_score") > 0) & (F.col("rival_score") <= F.col("baseline_score") * (1 - margin)) & ((F.col("folds") < 3) | (F.col("wins") > 0.5) & (F.col("gain") > 0))
    won = F.coalesce(beats, F.lit(False))
    return best.join(w, "series", "left").select("series", F.when(won, F.col("rival")).otherwise(F.col("baseline")).alias("model"), F.when(won, F.col("rival_score")).otherwise(F.col("baseline_score")).alias("score"), "baseline", "baseline_score")


def residuals(bt: DataFrame, chosen: DataFrame) -> DataFrame:
    """Errors of the chosen models by lead over the selection and calibration folds; the test fold is never used."""
    return bt.where("role <> 'test'").join(chosen.select("series", "model"), ["series", "model"]).select("series", "lead", (F.col("actual") - F.col("predicted")).alias("residual"))


def spreads(res: DataFrame, levels: tuple[float, ...] = QUANTILES, least: int = 8) -> DataFrame:
    """Conformal offsets by lead: of the lead's residuals where there are enough, else of all leads' together."""
    lead = res.groupBy("series", "lead").agg(F.collect_list("residual").alias("own"))
    pool = lead.groupBy("series").agg(F.flatten(F.collect_list("own")).alias("pool"))
    x = F.when(F.size("own") >= least, F.col("own")).otherwise(F.col("pool"))
    return lead.join(pool, "series").select("series", "lead", *[conformal_quantile(x, q).alias(f"s{round(q * 100):02d}") for q in levels])


def coverage(bt: DataFrame, chosen: DataFrame, spread: DataFrame, low: str = "s10", high: str = "s90") -> DataFrame:
    """The share of the test fold inside the band."""
    t = bt.where("role = 'test'").join(chosen.select("series", "model"), ["series", "model"]).join(spread, ["series", "lead"])
    inside = (F.col("actual") >= F.col("predicted") + F.col(low)) & (F.col("actual") <= F.col("predicted") + F.col(high))
    out = t.groupBy("series").agg(F.avg(inside.cast("int")).alias("coverage"), F.count("*").alias("n"))
    # What a few points can deny: the upper end of their 95 % interval.
    return out.withColumn("upper", wilson_upper(F.col("coverage") * F.col("n"), F.col("n")))


def pinball_scores(bt: DataFrame, chosen: DataFrame, spread: DataFrame, levels: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(series, level, loss): the mean quantile loss of every level on the test fold."""
    t = bt.where("role = 'test'").join(chosen.select("series", "model"), ["series", "model"]).join(spread, ["series", "lead"])
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("level"), (F.col("predicted") + F.col(f"s{round(q * 100):02d}")).alias("q")) for q in levels])).alias("x")
    rows = t.select("series", "actual", each)
    return rows.groupBy("series", F.col("x.level").alias("level")).agg(F.avg(pinball(F.col("actual"), F.col("x.q"), F.col("x.level"))).alias("loss"))


def dense_origins(df: DataFrame, horizon: int, season: int, stride: int = 1) -> DataFrame:
    """(series, origin): origins for selection only, `stride` apart, that end before the calibration fold begins.

    Overlapping folds compare models with less noise, but their residuals depend on each other and calibrate nothing.
    """
    first = max(2 * season, 2 * horizon, 8)
    n = df.groupBy("series").agg(F.count("*").alias("n"))
    folds_ = F.floor((F.col("n") - horizon - first) / horizon) + 1
    last = first + (folds_ - 3) * horizon
    return n.where(last >= first).select("series", F.explode(F.sequence(F.lit(first).cast("long"), last.cast("long"), F.lit(max(1, stride)).cast("long"))).alias("origin"))


def fitted(df: DataFrame, horizon: int, season: int, models: tuple[str, ...] = tuple(MODELS)) -> tuple[DataFrame, DataFrame]:
    """The backtest and the chosen models of every series with folds, each worked out once."""
    bt = materialised(backtest(df, horizon, season, models))
    return bt, materialised(select_model(fold_scores(bt)))


def published(df: DataFrame, bt: DataFrame, chosen: DataFrame, horizon: int, season: int, models: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """(series, model, step, point, q05 ... q95) of the chosen models fitted to all rows, with conformal quantiles.

    Offsets are made to grow with the lead, as the nearest that do in least squares, and quantiles of a step are in order.
    """
    spread = ordered_spreads(spreads(residuals(bt, chosen)))
    h = histories(df).join(chosen.select("series", "model"), "series")
    keep = max(MAX_FIT, 4 * season)
    h = h.withColumn("h", F.slice("h", F.greatest(F.lit(1), F.size("h") - keep + 1), F.lit(keep)))
    points = F.coalesce(*[F.when(F.col("model") == m, MODELS[m](F.col("h"), horizon, season)) for m in models])
    p = h.select("series", "model", F.posexplode(points).alias("i", "point")).withColumn("step", (F.col("i") + 1).cast("long"))
    out = p.join(spread.withColumnRenamed("lead", "step"), ["series", "step"], "left")
    # Leads that no fold reached have the spread of the last one that did.
    known = Window.partitionBy("series").orderBy("step")
    return out.select("series", "model", "step", "point", *[(F.col("point") + F.last(f"s{round(q * 100):02d}", True).over(known)).alias(f"q{round(q * 100):02d}") for q in QUANTILES])


def ordered_spreads(spread: DataFrame) -> DataFrame:
    """Spreads (series, lead, s05 ... s95) whose size never shrinks with the lead, and whose levels are in order.

    Upper offsets are replaced by the nearest rising ones in least squares, lower ones by the nearest falling; then each level
    is at least the one below.
    """
    names = [f"s{round(q * 100):02d}" for q in QUANTILES]
    seq = spread.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("lead", *names))).alias("x"))
    for n, q in zip(names, QUANTILES, strict=True):
        values = F.col(f"x.{n}")
        seq = seq.withColumn(n, isotonic(values) if q > 0.5 else F.transform(isotonic(F.transform(values, lambda v: -v)), lambda v: -v) if q < 0.5 else values)
    zipped = F.arrays_zip(F.col("x.lead").alias("lead"), *[F.col(n) for n in names])
    rows = seq.select("series", F.explode(zipped).alias("z")).select("series", "z.lead", *[F.col("z")[n].alias(n) for n in names])
    for a, b in zip(names, names[1:], strict=False):
        rows = rows.withColumn(b, F.greatest(a, b))
    return rows


def forecast(df: DataFrame, horizon: int, season: int, models: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """(series, model, step, point, q05 ... q95): chosen by backtest, published with conformal quantiles."""
    bt, chosen = fitted(df, horizon, season, models)
    return published(df, bt, chosen, horizon, season, models)


def holdouts(df: DataFrame, horizon: int, season: int) -> DataFrame:
    """The backtest of one trailing holdout, of min(horizon, a quarter of the rows), for series too short for two folds."""
    first = max(2 * season, 2 * horizon, 8)
    h = histories(df).withColumn("n", F.size("h")).where((F.col("n") >= horizon + 2) & (F.col("n") < first + 2 * horizon))
    size = F.least(F.lit(horizon), F.greatest(F.lit(1), F.floor(F.col("n") / 4).cast("int")))
    h = h.withColumn("k", size).withColumn("past", F.slice("h", F.lit(1), F.col("n") - F.col("k"))).withColumn("actual", F.slice("h", F.col("n") - F.col("k") + 1, F.col("k")))
    runs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), MODELS[m](F.col("past"), horizon, season).alias("p")) for m in MODELS]))
    x = h.select("series", (F.col("n") - F.col("k")).cast("long").alias("origin"), "k", "actual", runs.alias("r")).where("r.p is not null")
    each = F.posexplode(F.arrays_zip(F.col("actual").alias("a"), F.slice("r.p", F.lit(1), F.col("k")).alias("p"))).alias("i", "x")
    return x.select("series", "origin", F.lit("select").alias("role"), "r.model", each).select("series", "origin", "role", "model", (F.col("i") + 1).cast("long").alias("lead"), F.col("x.a").alias("actual"), F.col("x.p").alias("predicted"))


def ensemble_weights(scores: DataFrame, cap: float = 0.7, rounds: int = 3) -> DataFrame:
    """(series, model, weight): inverse mean errors over the selection folds, none over the cap for long.

    Models without a positive score have no weight, unless no model has one: then all weigh the same. What is over the cap
    goes to the others by weight, `rounds` times at most; at last the weights are made to sum to 1 again, so a model alone
    weighs 1.
    """
    mean = scores.where("role = 'select'").groupBy("series", "model").agg(F.avg("wape").alias("e"))
    w = Window.partitionBy("series")
    scored = F.col("e").isNotNull() & (F.col("e") > 0)
    mean = mean.withColumn("i", F.when(scored, 1 / F.col("e"))).withColumn("any", F.max("i").over(w))
    out = mean.withColumn("i", F.when(F.col("any").isNull(), F.lit(1.0)).otherwise(F.col("i"))).where("i is not null")
    out = out.select("series", "model", (F.col("i") / F.sum("i").over(w)).alias("w"))
    for _ in range(rounds):
        out = out.withColumn("over", F.sum(F.greatest(F.col("w") - cap, F.lit(0.0))).over(w)).withColumn("w", F.least("w", F.lit(cap)))
        free = F.sum(F.when(F.col("w") < cap, F.col("w"))).over(w)
        out = out.withColumn("w", F.when((F.col("over") > 1e-9) & (F.col("w") < cap) & (free > 0), F.col("w") + F.col("over") * F.col("w") / free).otherwise(F.col("w")))
    return out.select("series", "model", (F.col("w") / F.sum("w").over(w)).alias("weight"))


def ensemble(bt: DataFrame, scores: DataFrame, cap: float = 0.7) -> DataFrame:
    """Weighted mean, median and vote over models by fold and lead.

    The vote takes the median of the side, above or below the last value, that more than half of the models with a side are
    on; without one, the median of all. `last_value` must be among the models for it.
    """
    weight = ensemble_weights(scores, cap)
    last = F.max(F.when(F.col("model") == "last_value", F.col("predicted"))).over(Window.partitionBy("series", "origin"))
    j = bt.withColumn("last", last).join(weight, ["series", "model"], "left")
    up, down = F.col("predicted") > F.col("last"), F.col("predicted") < F.col("last")
    half = F.lit(0.5)
    out = j.groupBy("series", "origin", "role", "lead").agg(
        F.first("actual").alias("actual"),
        F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("predicted")).alias("weighted"),
        F.percentile("predicted", half).alias("median"),
        F.percentile(F.when(up, F.col("predicted")), half).alias("_above"),
        F.percentile(F.when(down, F.col("predicted")), half).alias("_below"),
        F.count_if(up).alias("_u"),
        F.count_if(down).alias("_d"),
    )
    cast = (F.col("_u") + F.col("_d")) * 0.5
    vote = F.when(F.col("_u") > cast, F.col("_above")).when(F.col("_d") > cast, F.col("_below")).otherwise(F.col("median"))
    return out.withColumn("vote", vote).drop("_above", "_below", "_u", "_d")


def combine_quantiles(quantiles: DataFrame, how: str = "union") -> DataFrame:
    """Of (series, step, model, level, value[, weight]): one value for each level.

    union: the widest band; intersection: the narrowest; weighted: by weight; mean: plainly.
    """
    low = F.first("level") <= 0.5
    wide, narrow = F.when(low, F.min("value")).otherwise(F.max("value")), F.when(low, F.max("value")).otherwise(F.min("value"))
    mean = F.avg("value")
    if how == "weighted":
        total = F.sum("weight")
        weighted = F.when(total > 0, F.sum(F.col("weight") * F.col("value")) / total).otherwise(mean)
    value = {"union": lambda: wide, "intersection": lambda: narrow, "weighted": lambda: weighted, "mean": lambda: mean}[how]()
    return quantiles.groupBy("series", "step", "level").agg(value.alias("value"))
