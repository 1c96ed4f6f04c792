"""One call for each question about timestamped data: inspect, describe, forecast, investigate, detect, decide, monitor.

Each takes the long frame (series, ts, value) and returns a DataFrame; nothing is collected but what a plan needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import indexed, materialised
from .operators import anomalies, decisions, descriptive, evaluate, evidence, quality, questions, results

# Default seasons of named steps: fixed values.
SEASONS = {"s": 60, "min": 60, "5min": 288, "15min": 96, "30min": 48, "h": 24, "D": 7, "W": 52, "MS": 12}
CYCLES = (86400, 3600, 60)


def default_season(frequency: str) -> int:
    """The season of a step that nothing was measured for: a named one, or a day, hour or minute that has 2 to 288 steps."""
    if frequency in SEASONS:
        return SEASONS[frequency]
    found = re.fullmatch(r"(\d+)(s|min|h)", frequency)
    if found:
        step = int(found[1]) * {"s": 1, "min": 60, "h": 3600}[found[2]]
        for cycle in CYCLES:
            if 2 <= round(cycle / step) <= 288:
                return round(cycle / step)
    return 1


def inspect(df: DataFrame) -> DataFrame:
    """Step, rows, span and holes of each series."""
    step = quality.infer_step(df)
    span = df.groupBy("series").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("ts").alias("n_ts"))
    seconds = F.unix_timestamp(F.col("last_ts").cast("timestamp")) - F.unix_timestamp(F.col("first_ts").cast("timestamp"))
    out = span.join(step, "series", "left")
    return out.withColumn("missing", F.greatest(F.floor(seconds / F.col("step_seconds")) + 1 - F.col("n_ts"), F.lit(0))).withColumn("duplicates", F.col("n_rows") - F.col("n_ts"))


def quality_levels(df: DataFrame) -> DataFrame:
    """(series, status, exact, conflicts, missing): the least repair that loads each series on a daily grid.

    clean needs none; repaired_safe has rows to collapse that are exactly equal; repaired_aggressive has rows of one time that
    differ, or gaps short enough to fill; refused has gaps that must not be filled.
    """
    a = df.groupBy("series", "ts").agg(F.count("*").alias("n"), F.count_distinct("value").alias("k"))
    d = a.groupBy("series").agg(F.sum(F.col("n") - F.col("k")).alias("exact"), F.sum(F.col("k") - 1).alias("conflicts"))
    gaps = quality.fill_refusals(a.select("series", "ts"))
    x = d.join(gaps, "series")
    status = F.when(F.col("problem").isNotNull(), "refused").when((F.col("conflicts") > 0) | (F.col("filled") > 0), "repaired_aggressive").when(F.col("exact") > 0, "repaired_safe").otherwise("clean")
    return x.select("series", status.alias("status"), "exact", "conflicts", F.col("filled").alias("missing"))


def describe(df: DataFrame) -> DataFrame:
    """A summary of each series."""
    return descriptive.profile(indexed(df))


def forecast(df: DataFrame, horizon: int, season: int | None = None, step: str | None = None) -> DataFrame:
    """(series, step, model, point, q05 ... q95, tier): every series gets rows.

    Series with folds get the model that their backtest chose, graded by how many folds and what coverage they had; shorter
    ones the strongest baseline on one trailing holdout; the rest their last value with a random-walk band, as best effort.
    With a step (D, W, MS, <N>s, <N>min, <N>h) there is `ts`, and its season is used where none is given.
    """
    season = season or default_season(step or "")
    s = indexed(df)
    bt, chosen = evaluate.fitted(s, horizon, season)
    full = evaluate.published(s, bt, chosen, horizon, season)
    spread = evaluate.ordered_spreads(evaluate.spreads(evaluate.residuals(bt, chosen)))
    folds = bt.groupBy("series").agg(F.count_distinct("origin").alias("folds")).join(evaluate.coverage(bt, chosen, spread).select("series", "coverage"), "series", "left")
    grade = results.graded(folds.withColumn("horizon", F.lit(horizon)).withColumn("requested", F.lit(horizon))).select("series", "tier")
    full = full.join(grade, "series")
    rest = s.join(full.select("series").distinct(), "series", "left_anti")
    one = materialised(evaluate.holdouts(rest, horizon, season))
    picked = results.lightweight(evaluate.fold_scores(one))
    short = evaluate.published(rest, one, picked, horizon, season).withColumn("tier", F.lit("conditionally_supported"))
    last = results.best_effort(rest.join(picked.select("series"), "series", "left_anti"), horizon).withColumn("model", F.lit("last_value"))
    out = full.unionByName(short).unionByName(last)
    return out.join(evidence.future_grid(df, horizon, step), ["series", "step"]) if step else out


def investigate(df: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """What changed: up to three mean shifts of each series, ranked by what they explain, and the regime since each."""
    s = indexed(df)
    found = materialised(descriptive.changepoints(s, sensitivity))
    ranks = results.ranked_changes(found).select("series", "split", "rank", "dominant")
    return found.join(ranks, ["series", "split"]).join(descriptive.regimes(s, found).select("series", "split", "post", "regime"), ["series", "split"])


def detect(df: DataFrame, season: int = 1, threshold: float = descriptive.THRESHOLD) -> DataFrame:
    return descriptive.detect(indexed(df), season, threshold).where("votes > 0")


def graded(df: DataFrame, season: int = 1, threshold: float = descriptive.THRESHOLD) -> DataFrame:
    """Every row scored by the detector that best recovers planted anomalies in its series."""
    return anomalies.detected(indexed(df), season, threshold)


def ask(df: DataFrame, question: dict) -> DataFrame:
    """The answer to a typed question about series of the frame."""
    names = [r["series"] for r in df.select("series").distinct().collect()]
    return questions.answered(indexed(df), questions.compiled(question, names))


def _risk(df: DataFrame, horizon: int, season: int, threshold: float) -> DataFrame:
    s = indexed(df)
    bt, chosen = evaluate.fitted(s, horizon, season)
    return decisions.threshold_risk(evaluate.published(s, bt, chosen, horizon, season), evaluate.residuals(bt, chosen), threshold)


def monitor(df: DataFrame, horizon: int, season: int, threshold: float, alert_cost: float = 1.0, miss_cost: float = 1.0) -> DataFrame:
    """The risk of crossing a threshold and the first step at which an alert pays."""
    return decisions.risk_summary(_risk(df, horizon, season, threshold), alert_cost, miss_cost)


def decide(df: DataFrame, horizon: int, season: int, threshold: float, utility: dict[str, tuple[float, float]]) -> DataFrame:
    """Actions by expected utility, each given as (utility if the threshold is passed, utility if not)."""
    peak = _risk(df, horizon, season, threshold).groupBy("series").agg(F.max("p").alias("p"))
    table = peak.select("series", F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(x).alias("hit"), F.lit(y).alias("miss")) for a, (x, y) in sorted(utility.items())])).alias("a"), "p")
    return table.select("series", "a.action", (F.col("p") * F.col("a.hit") + (1 - F.col("p")) * F.col("a.miss")).alias("utility"), "p")
