"""From forecasts to actions: threshold risk, alerts, expected utility, maximin, regret."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_risk(points: DataFrame, residuals: DataFrame, threshold: float) -> DataFrame:
    """P(value > threshold) at each step, by adding the series' past residuals of that lead to its point."""
    both = points.join(residuals.withColumnRenamed("lead", "step"), ["series", "step"])
    return both.groupBy("series", "step").agg(F.avg((F.col("point") + F.col("residual") > threshold).cast("int")).alias("p"))


def risk_summary(risk: DataFrame, alert_cost: float = 1.0, miss_cost: float = 1.0) -> DataFrame:
    """The peak probability, the chance of any step under independence, and the first step worth an alert."""
    at = alert_cost / (alert_cost + miss_cost)
    stay = F.when(F.max("p") >= 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(F.col("p") < 1, F.log(1 - F.col("p"))))))
    return risk.groupBy("series").agg(F.max("p").alias("peak"), (1 - stay).alias("any_step"), F.min(F.when(F.col("p") >= at, F.col("step"))).alias("alert_step"))


def expected_utility(table: DataFrame) -> DataFrame:
    """Of (action, scenario, p, utility): the expected utility of every action, and its rank; ties go by name."""
    out = table.groupBy("action").agg(F.sum(F.col("p") * F.col("utility")).alias("utility"), F.sum("p").alias("p"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("utility").desc(), "action")).cast("long"))


def maximin(table: DataFrame) -> DataFrame:
    """Actions by their worst case, then their mean, then their name."""
    out = table.groupBy("action").agg(F.min("utility").alias("worst"), F.avg("utility").alias("mean"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("worst").desc(), F.col("mean").desc(), "action")).cast("long"))


def regret(table: DataFrame) -> DataFrame:
    """For each scenario, what every action loses against the best feasible one."""
    best = F.max(F.when(F.col("feasible"), F.col("utility"))).over(Window.partitionBy("scenario"))
    return table.withColumn("regret", best - F.col("utility"))


def simulate(points: DataFrame, shift: float = 0.0, scale: float = 1.0, from_step: int = 1) -> DataFrame:
    """The forecast under a shift and a scale that begin at a step."""
    return points.withColumn("point", F.when(F.col("step") >= from_step, F.col("point") * scale + shift).otherwise(F.col("point")))


def any_step(risk: DataFrame) -> DataFrame:
    """(series, peak, any_step): the largest step probability, and 1 - product of (1 - p)."""
    return risk_summary(risk).select("series", "peak", "any_step")


def evaluated_actions(table: DataFrame) -> DataFrame:
    """Of (action, scenario, p, utility, feasible): expected utilities of feasible actions, ranked; status says what is missing.

    degraded where a utility is null; invalid where the probabilities of an action do not add to 1 within 0.05.
    """
    a = table.groupBy("action").agg(F.bool_and("feasible").alias("feasible"), F.sum(F.col("p") * F.col("utility")).alias("utility"), F.sum("p").alias("p"), F.count_if(F.col("utility").isNull()).alias("none"))
    status = F.when(F.abs(F.col("p") - 1) > 0.05, "invalid").when(F.col("none") > 0, "degraded").when(~F.col("feasible"), "infeasible").otherwise("evaluated")
    a = a.withColumn("status", status)
    usable = F.col("status") == "evaluated"
    rank = F.when(usable, F.row_number().over(Window.partitionBy(usable).orderBy(F.col("utility").desc(), "action")))
    return a.select("action", "status", F.when(F.col("none") == 0, F.col("utility")).alias("utility"), rank.cast("long").alias("rank"))
