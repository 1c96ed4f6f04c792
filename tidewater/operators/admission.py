"""Whether and how far a candidate forecast may replace the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import by_series
from ..functions.stats import TINY
from .ledger import normal_cdf


def output_diagnostics(history: DataFrame, paths: DataFrame) -> DataFrame:
    """Of (series, idx, value) and (series, step, candidate, baseline): facts about the candidate's path.

    (series, valid, boundary_jump, scale_ratio, oscillation_ratio, disagreement), in units of the median absolute difference
    of the history, or of its range where that vanishes. Paths with a missing or infinite value are not valid.
    """
    d = history.withColumn("_d", F.abs(F.col("value") - F.lag("value").over(by_series("idx"))))
    h = d.groupBy("series").agg(F.percentile("_d", F.lit(0.5)).alias("m"), (F.max("value") - F.min("value")).alias("span"), F.max_by("value", "idx").alias("last"))
    unit = F.when(F.coalesce("m", F.lit(0.0)) > TINY, F.col("m")).otherwise(F.greatest("span", F.lit(1.0)))
    w = Window.partitionBy("series").orderBy("step")
    p = paths.withColumn("_c", F.col("candidate") - F.lag("candidate").over(w))
    p = p.withColumn("_t", (F.col("_c") * F.lag("_c").over(w) < 0).cast("int"))
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    a = p.groupBy("series").agg(F.bool_and(fine("candidate") & fine("baseline")).alias("valid"), F.min_by("candidate", "step").alias("first"), F.percentile(F.abs("_c"), F.lit(0.5)).alias("s"), F.sum("_t").alias("turns"), F.count("_c").alias("n"), F.avg(F.abs(F.col("candidate") - F.col("baseline"))).alias("gap"))
    x = a.join(h, "series").withColumn("unit", unit)
    of = lambda v: F.when(F.col("valid"), v)
    return x.select(
        "series",
        "valid",
        of(F.abs(F.col("first") - F.col("last")) / F.col("unit")).alias("boundary_jump"),
        of(F.coalesce("s", F.lit(0.0)) / F.col("unit")).alias("scale_ratio"),
        of(F.coalesce("turns", F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("oscillation_ratio"),
        of(F.col("gap") / F.col("unit")).alias("disagreement"),
    )


def decided(evidence: DataFrame, margin: float = 0.02) -> DataFrame:
    """Of (key, valid, folds, gain, gain_se, win_rate, median_gain, prior_gain, prior_se, relevance): (key, state, policy, weight).

    Locally validated with two folds, the margin, most wins and a positive median gain; externally with a relevant prior that
    is positive with 95 %, where there is no fold. Otherwise what both say, pooled by precision, assists: its weight 2 P - 1
    is priced by relevance, halved where the two disagree, and at most 0.75. Priors discount with their relevance; a single
    fold counts with a standard error of 0.15 at least. An invalid output falls back to the baseline.
    """
    c = F.col
    relevance = F.greatest(F.lit(0.05), F.least(F.lit(1.0), c("relevance")))
    e_gain, e_se = c("prior_gain") * relevance, c("prior_se") / F.sqrt(relevance)
    l_se = F.coalesce("gain_se", F.when(c("folds") == 1, F.greatest(F.lit(0.15), F.abs("gain"))))
    has_e, has_l = c("prior_gain").isNotNull(), c("gain").isNotNull() & l_se.isNotNull()
    precision = F.when(has_e, 1 / (e_se * e_se)).otherwise(0.0) + F.when(has_l, 1 / (l_se * l_se)).otherwise(0.0)
    mu = (F.when(has_e, e_gain / (e_se * e_se)).otherwise(0.0) + F.when(has_l, c("gain") / (l_se * l_se)).otherwise(0.0)) / precision
    p = F.when(has_e | has_l, normal_cdf(mu * F.sqrt(precision)))
    local = F.coalesce((c("folds") >= 2) & (c("gain") >= margin) & (c("win_rate") > 0.5) & (c("median_gain") > 0), F.lit(False))
    external = F.coalesce(has_e & (c("relevance") >= 0.75) & (c("prior_gain") > 0) & (normal_cdf(c("prior_gain") / c("prior_se")) >= 0.95), F.lit(False))
    conflict = F.coalesce(c("prior_gain") * c("gain") < 0, F.lit(False))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * p - 1))
    assisted = F.least(raw * F.coalesce("relevance", F.lit(1.0)) * F.when(conflict, 0.5).otherwise(1.0), F.lit(0.75))
    state = F.when(~c("valid"), "baseline_fallback").when(local & external, "jointly_validated").when(local, "locally_validated").when(external & (c("folds") == 0), "externally_validated").when(p.isNotNull(), "prior_assisted").otherwise("baseline_fallback")
    x = evidence.withColumn("p", p).withColumn("state", state)
    weight = F.when(c("state").isin("jointly_validated", "locally_validated"), 1.0).when(c("state") == "externally_validated", F.when(raw >= 0.9, 1.0).otherwise(raw)).when(c("state") == "prior_assisted", assisted).otherwise(0.0)
    x = x.withColumn("weight", weight)
    x = x.withColumn("state", F.when(c("weight") > 0, c("state")).otherwise("baseline_fallback"))
    policy = F.when(c("weight") >= 1, "candidate").when(c("weight") > 0, "shrunk_blend").otherwise("baseline")
    return x.select("key", "state", policy.alias("policy"), "weight", "p")
