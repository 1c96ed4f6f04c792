"""What the engine can do: each operator with what its answer is worth, and the calls made of several."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import api
from .operators import admission, anomalies, bitemporal, context, decisions, descriptive, evaluate, evidence, ledger, multivariate, quality, results, volatility, windows


@dataclass(frozen=True)
class Operator:
    name: str
    claim: str  # descriptive, associational, predictive or decision
    run: Callable[..., DataFrame]

    @property
    def summary(self) -> str:
        return (self.run.__doc__ or "").strip().split("\n")[0]


OPERATORS = {
    o.name: o
    for o in (
        Operator("select_window", "descriptive", windows.select_window),
        Operator("resample_aggregate", "descriptive", windows.resample),
        Operator("difference", "descriptive", windows.difference),
        Operator("infer_frequency", "descriptive", quality.named_step),
        Operator("join_as_of", "descriptive", bitemporal.join_as_of),
        Operator("changepoint_detection", "descriptive", descriptive.changepoints),
        Operator("regime_detection", "descriptive", descriptive.regimes),
        Operator("anomaly_score", "descriptive", descriptive.anomaly_score),
        Operator("seasonality_analysis", "descriptive", evidence.detect_season),
        Operator("window_evidence", "descriptive", evidence.compared),
        Operator("cross_correlation", "associational", descriptive.cross_correlation),
        Operator("event_study", "associational", descriptive.event_study),
        Operator("conditional_effects", "associational", context.conditional_effects),
        Operator("detect_anomalies", "descriptive", anomalies.detected),
        Operator("evaluate", "predictive", evaluate.backtest),
        Operator("forecast", "predictive", evaluate.forecast),
        Operator("var_forecast", "predictive", multivariate.var_forecast),
        Operator("volatility", "predictive", volatility.forecast),
        Operator("admission", "predictive", admission.decided),
        Operator("simulate_scenario", "decision", decisions.simulate),
        Operator("evaluate_threshold_risk", "decision", decisions.threshold_risk),
        Operator("evaluate_actions", "decision", decisions.evaluated_actions),
        Operator("route", "descriptive", ledger.route_prior),
        Operator("triage", "descriptive", results.triage),
    )
}
MACROS = {"inspect": api.inspect, "describe": api.describe, "forecast": api.forecast, "investigate": api.investigate, "detect": api.graded, "decide": api.decide, "monitor": api.monitor, "ask": api.ask}


def capabilities(spark: SparkSession) -> DataFrame:
    """(name, kind, claim, summary) of all operators and calls."""
    rows = [(o.name, "operator", o.claim, o.summary) for o in OPERATORS.values()]
    rows += [(n, "call", None, (f.__doc__ or "").strip().split("\n")[0]) for n, f in MACROS.items()]
    return spark.createDataFrame(rows, "name string, kind string, claim string, summary string")
