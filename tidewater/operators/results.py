"""Queries over published results: selection, triage, ranking, splits and fallbacks."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import by_series
from .evaluate import QUANTILES
from .models import BASELINES


def notability(rows: DataFrame) -> DataFrame:
    """Of forecast rows (series, step, point, crosses): (series, notability), 10 for a crossing plus the relative movement."""
    a = rows.groupBy("series").agg(F.min_by("point", "step").alias("a"), F.max_by("point", "step").alias("b"), F.coalesce(F.bool_or("crosses"), F.lit(False)).alias("x"), F.count("*").alias("n"))
    move = F.when(F.col("n") > 1, F.abs(F.col("b") - F.col("a")) / F.greatest(F.abs("a"), F.lit(1e-12))).otherwise(0.0)
    return a.select("series", F.round(F.when(F.col("x"), 10.0).otherwise(0.0) + move, 6).alias("notability"))


def select_results(rows: DataFrame, series: list[str] | None = None, where: dict | None = None, order_by: str | None = None, limit: int | None = None, fields: list[str] | None = None) -> tuple[DataFrame, int]:
    """Results of the named series that match all of `where`, ordered by notability or series, the first `limit`, with
    `fields` and the series; and how many matched before the limit."""
    out = rows
    if series:
        out = out.where(F.col("series").isin(list(series)))
    for key, value in (where or {}).items():
        out = out.where(F.col(key).eqNullSafe(F.lit(value)))
    matched = out.count()
    if order_by == "notability":
        out = out.orderBy(F.coalesce("notability", F.lit(0.0)).desc(), "series")
    elif order_by == "series":
        out = out.orderBy("series")
    elif order_by is not None:
        raise ValueError("order_by is notability or series")
    if limit is not None:
        out = out.limit(limit)
    return (out.select(*dict.fromkeys(["series", *fields])) if fields else out), matched


def triage(rows: DataFrame, k: int = 3) -> DataFrame:
    """(place, series, notability, tier, n): the k most notable results, and the others counted by tier."""
    top = rows.orderBy(F.col("notability").desc(), "series").limit(k)
    head = top.select("series", "notability", "tier", F.row_number().over(Window.orderBy(F.col("notability").desc(), "series")).cast("long").alias("place"), F.lit(1).cast("long").alias("n"))
    rest = rows.join(top.select("series"), "series", "left_anti").groupBy("tier").agg(F.count("*").alias("n"))
    return head.unionByName(rest.select(F.lit(None).cast(rows.schema["series"].dataType).alias("series"), F.lit(None).cast("double").alias("notability"), "tier", F.lit(None).cast("long").alias("place"), "n"))


def ranked_changes(splits: DataFrame) -> DataFrame:
    """Of `changepoints`: (series, split, share, rank, dominant); dominant are those of half of the strongest or more."""
    w = Window.partitionBy("series")
    rank = F.row_number().over(w.orderBy(F.col("relative_gain").desc(), "split")).cast("long")
    top = F.max("relative_gain").over(w)
    return splits.select("series", "split", F.col("relative_gain").alias("share"), rank.alias("rank"), ((top > 0) & (F.col("relative_gain") >= top / 2)).alias("dominant"))


def head_tail(rows: DataFrame, head: int = 3, tail: int = 2) -> DataFrame:
    """The first and last rows of every series by idx: what fits a response."""
    n = F.count("*").over(Window.partitionBy("series"))
    return rows.withColumn("_n", n).withColumn("_k", F.row_number().over(by_series("idx"))).where((F.col("_k") <= head) | (F.col("_k") > F.col("_n") - tail)).drop("_n", "_k")


def tier_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tier").agg(F.count("*").alias("n"))


def id_mismatches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with `side`; none means the two may be compared."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("b")))


def flag_sets(flagged: DataFrame, clean: DataFrame, hits: DataFrame, injected: DataFrame) -> DataFrame:
    """Of (series, idx) sets: novel flags, those not on the clean series, and whether they are stray, neither hits nor injected."""
    key = ["series", "idx"]
    novel = flagged.select(*key).distinct().join(clean.select(*key).distinct(), key, "left_anti")
    known = hits.select(*key).unionByName(injected.select(*key)).distinct().withColumn("_k", F.lit(1))
    return novel.join(known, key, "left").withColumn("stray", F.col("_k").isNull()).drop("_k")


def false_alarms(stray: DataFrame) -> DataFrame:
    """(series, alarms): stretches of consecutive stray flags, as one wide response is one alarm."""
    island = F.col("idx") - F.row_number().over(by_series("idx"))
    return stray.withColumn("_i", island).groupBy("series").agg(F.count_distinct("_i").alias("alarms"))


def supportable_horizons(df: DataFrame, season: int) -> DataFrame:
    """(series, n, horizon): the longest horizon of at most a quarter of the rows that two separate folds fit; else null."""
    n = df.groupBy("series").agg(F.count("*").alias("n"))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.floor(F.col("n") / 4), F.lit(1))), lambda h: (h <= F.floor(F.col("n") / 4)) & (F.col("n") >= F.greatest(F.lit(2 * season), 2 * h, F.lit(8)) + 2 * h))
    return n.select("series", "n", F.array_max(fits).alias("horizon"))


def best_effort(df: DataFrame, horizon: int) -> DataFrame:
    """(series, step, point, q05 ... q95, tier): the last value and a random-walk band, for series that nothing was fitted to.

    The deviation is that of the first differences; of one difference its size, of none 0.
    """
    d = df.withColumn("_d", F.col("value") - F.lag("value").over(by_series("idx")))
    a = d.groupBy("series").agg(F.max_by("value", "idx").alias("point"), F.count("_d").alias("n"), F.stddev_samp("_d").alias("s"), F.max(F.abs("_d")).alias("one"))
    sigma = F.when(F.col("n") >= 2, F.col("s")).when(F.col("n") == 1, F.col("one")).otherwise(0.0)
    steps = a.select("series", "point", sigma.alias("_s"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))).alias("step"))
    wide = F.col("_s") * F.sqrt("step")
    q = [(F.col("point") + F.lit(NormalDist().inv_cdf(level)) * wide).alias(f"q{round(level * 100):02d}") for level in QUANTILES]
    return steps.select("series", "step", "point", *q, F.lit("best_effort").alias("tier"))


def horizon_split(supported: DataFrame, fallback: DataFrame, prefix: DataFrame) -> DataFrame:
    """Rows of a forecast up to each series' supported horizon (series, horizon), and of the fallback beyond it."""
    a = supported.join(prefix, "series").where(F.col("step") <= F.col("horizon")).drop("horizon")
    b = fallback.join(prefix, "series", "left").where(F.col("step") > F.coalesce("horizon", F.lit(0))).drop("horizon")
    return a.unionByName(b, allowMissingColumns=True)


def lightweight(scores: DataFrame) -> DataFrame:
    """Of one fold's (series, model, wape): the strongest baseline, as one fold ranks no candidates; else the best model.

    (series, model, score, guarded): guarded says that other models had scores too.
    """
    s = scores.where("wape is not null").withColumn("base", F.col("model").isin(*BASELINES))
    a = s.groupBy("series").agg(F.min(F.when(F.col("base"), F.struct("wape", "model"))).alias("b"), F.min(F.struct("wape", "model")).alias("o"), F.count_if(~F.col("base")).alias("n"))
    pick = F.coalesce("b", "o")
    return a.select("series", pick["model"].alias("model"), pick["wape"].alias("score"), (F.col("b").isNotNull() & (F.col("n") > 0)).alias("guarded"))


def graded(rows: DataFrame, least_folds: int = 4, least_coverage: float = 0.7) -> DataFrame:
    """Of (series, folds, coverage, horizon, requested): status, tier and one sentence.

    supported with enough folds and coverage for the whole horizon; conditionally supported with less of either; best effort
    where no fold ran.
    """
    c = F.col
    status = F.when(c("folds") == 0, "inconclusive").when((c("folds") >= least_folds) & (F.coalesce("coverage", F.lit(0.0)) >= least_coverage), "supported").otherwise("conditionally_supported")
    out = rows.withColumn("status", status).withColumn("tier", F.when(status == "inconclusive", "best_effort").otherwise(status))
    text = (
        F.when(c("tier") == "best_effort", F.lit("No evaluated forecast is possible; this is a naive extrapolation for orientation only."))
        .when(c("horizon") < c("requested"), F.format_string("Evaluated through step %d (%s); later steps are a naive extrapolation.", c("horizon"), c("tier")))
        .when(c("tier") == "supported", F.format_string("Forecast selected on %d separated folds against the mandatory baselines.", c("folds")))
        .otherwise(F.format_string("Forecast with caveats: %d folds, coverage %s.", c("folds"), F.coalesce(F.format_number("coverage", 2), F.lit("unmeasured"))))
    )
    return out.withColumn("headline", text)


def decide_state(probabilities: DataFrame, least: float = 0.6, folds: int = 8, accuracy: float = 0.5, skill: float = 0.0) -> DataFrame:
    """Of (series, label, p, point_state, folds, accuracy, skill): the likeliest label where all gates are met, else the point
    estimate's, as a noisy mode is no claim."""
    best = probabilities.groupBy("series").agg(F.max(F.struct("p", (F.col("label") == F.col("point_state")).alias("own"), "label")).alias("b"), *[F.first(c).alias(c) for c in ("point_state", "folds", "accuracy", "skill")])
    ok = (F.col("folds") >= folds) & (F.col("accuracy") >= accuracy) & (F.col("skill") >= skill) & (F.col("b.p") >= least)
    return best.select("series", F.when(ok, F.col("b.label")).otherwise(F.col("point_state")).alias("state"), F.col("b.label").alias("mode"), F.col("b.p").alias("p"), ok.alias("automatic"))


# What each source of evidence weighs by its support: fixed values.
SUPPORT_WEIGHT = {"supported": 1.0, "weak": 0.25, "abstained": 0.0}


def adjudicate(votes: DataFrame) -> DataFrame:
    """Of (series, value, source, support, canonical): (series, rank, value, weight, sources, margin), the weighted vote.

    Ties go to more sources, then to the canonical answer, then by name.
    """
    weight = F.coalesce(*[F.when(F.col("support") == k, F.lit(v)) for k, v in SUPPORT_WEIGHT.items()], F.lit(0.25))
    a = votes.where(~F.col("value").isin("uncertain", "unknown")).groupBy("series", "value").agg(F.sum(weight).alias("weight"), F.count("*").alias("sources"), F.max(F.col("value") == F.col("canonical")).alias("own"))
    w = Window.partitionBy("series").orderBy(F.col("weight").desc(), F.col("sources").desc(), F.col("own").desc(), "value")
    a = a.withColumn("rank", F.row_number().over(w).cast("long"))
    margin = F.when(F.col("rank") == 1, F.col("weight") - F.coalesce(F.lead("weight").over(w), F.lit(0.0)))
    return a.withColumn("margin", margin).drop("own")
