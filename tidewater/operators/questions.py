"""Typed questions about a series: checked, matched to what can answer them, and answered from evidence or a forecast."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import descriptive, evidence, windows

# The vocabulary: fixed values.
VERBS = ("describe", "predict", "compare", "detect", "decide", "test", "decompose", "regress")
PROPERTIES = ("level", "trend", "seasonality", "volatility", "regime", "extreme", "dependence", "stationarity", "decomposition", "regression")
MEASURES = ("point", "slope", "period", "residual_scale", "marginal_variability", "change", "maximum", "minimum", "correlation", "test_statistic", "components", "coefficients", "validation_error")
SCOPES = ("series", "pair", "each", "aggregate")
POLICIES = ("ignore", "measure", "scenario")
AGGREGATIONS = {"volatility": "median_normalized_scale_ratio", "seasonality": "median_alignment"}
ALIASES = {"average": "level", "mean": "level", "value": "level", "direction": "trend", "growth": "trend", "seasonal": "seasonality", "cycle": "seasonality", "variance": "volatility", "variability": "volatility", "noise": "volatility", "dispersion": "volatility", "changepoint": "regime", "shift": "regime", "outlier": "extreme", "peak": "extreme", "relationship": "dependence", "correlation": "dependence"}
# What can answer what: name, properties, verbs, methods.
CAPABILITIES = (
    ("temporal_property", PROPERTIES[:7], ("describe", "predict", "compare", "detect", "decide"), ()),
    ("stationarity", ("stationarity",), ("test", "describe"), ("adf", "kpss")),
    ("fixed_period_decomposition", ("decomposition",), ("decompose", "describe"), ("centered_moving_average",)),
    ("exogenous_regression", ("regression",), ("regress", "predict"), ("ridge_linear",)),
)


class QuestionError(ValueError):
    """INVALID_TEMPORAL_QUESTION, with what is wrong by field."""

    def __init__(self, failures: dict):
        super().__init__(f"INVALID_TEMPORAL_QUESTION: {failures}")
        self.failures = failures


@dataclass(frozen=True)
class Question:
    verb: str
    property: str
    members: tuple[str, ...]
    scope: str = "series"
    horizon: int | None = None
    measure: str | None = None
    method: str | None = None
    period: int | None = None
    context_policy: str = "ignore"
    aggregation: str | None = None


def compiled(raw: dict, targets: list[str]) -> Question:
    """A question bound to exact targets; nothing is guessed but the one target there is and invariant other names."""
    if not isinstance(raw, dict):
        raise QuestionError({"question": "must be an object"})
    bad: dict = {}
    verb = str(raw.get("verb", "describe")).strip().lower()
    named = str(raw.get("property", "")).strip().lower()
    prop = ALIASES.get(named, named)
    target, scope, aggregation = raw.get("target", ""), "series", None
    if isinstance(target, dict):
        scope, aggregation = str(target.get("kind", "")).lower(), target.get("aggregation")
        members = tuple(str(m) for m in target.get("members", []))
    else:
        name = str(target).strip() or (targets[0] if len(targets) == 1 else "")
        members = (name,)
    checks = (
        ("verb", verb in VERBS, VERBS),
        ("property", prop in PROPERTIES, PROPERTIES),
        ("target.kind", scope in SCOPES, SCOPES),
        ("target.members", bool(members) and set(members) <= set(targets), targets),
        ("measure", raw.get("measure") is None or raw["measure"] in MEASURES, MEASURES),
        ("context_policy", raw.get("context_policy", "ignore") in POLICIES, POLICIES),
    )
    bad |= {field: {"allowed": list(allowed)} for field, ok, allowed in checks if not ok}
    if scope == "pair" and (len(members) != 2 or len(set(members)) != 2 or prop != "dependence"):
        bad["target.kind"] = "a pair is two distinct members and is asked for dependence"
    if prop == "dependence" and scope != "pair":
        bad["target.kind"] = "dependence is asked of a pair"
    if scope == "aggregate":
        aggregation = aggregation or AGGREGATIONS.get(prop)
        if len(members) < 2 or prop not in AGGREGATIONS or aggregation != AGGREGATIONS[prop]:
            bad["target.aggregation"] = {"allowed": [AGGREGATIONS[prop]] if prop in AGGREGATIONS else []}
    for field in ("horizon", "period"):
        n = raw.get(field)
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 1):
            bad[field] = "must be a positive whole number"
    if bad:
        raise QuestionError(bad)
    return Question(verb, prop, members, scope, raw.get("horizon"), raw.get("measure"), raw.get("method"), raw.get("period"), raw.get("context_policy", "ignore"), aggregation)


def planned(question: Question) -> dict:
    """ready with the capability that answers it, or unsupported with the reason."""
    for name, properties, verbs, methods in CAPABILITIES:
        if question.property in properties and question.verb in verbs:
            if question.method and methods and question.method not in methods:
                return {"status": "unsupported", "reason": f"{name} has the methods {', '.join(methods)}", "question": asdict(question)}
            return {"status": "ready", "capability": name, "question": asdict(question)}
    return {"status": "unsupported", "reason": f"nothing answers {question.verb}/{question.property}", "question": asdict(question)}


def answered(df: DataFrame, question: Question) -> DataFrame:
    """(series, property, value, direction, support) for the members of a question, from rows (series, idx, ts, value).

    Properties are answered from the last two windows, seasonality and dependence from correlations, tests and decompositions
    by their statistic. An aggregate is the median over the members, a vote for its direction.
    """
    plan = planned(question)
    if plan["status"] != "ready":
        raise QuestionError({"verb": plan["reason"]})
    rows, season = df.where(F.col("series").isin(list(question.members))), question.period or 1
    shape = lambda d, value, direction, support: d.select("series", F.lit(question.property).alias("property"), F.col(value).cast("double").alias("value"), direction.cast("string").alias("direction"), support.alias("support"))
    if question.property == "stationarity":
        if question.method == "kpss":
            out = evidence.kpss(rows)
            return shape(out, "statistic", F.col("conclusion"), F.lit("supported"))
        out = descriptive.stationarity(rows)
        return shape(out, "t", F.when(F.col("stationary"), "stationary").otherwise("unit_root_not_rejected"), F.lit("supported"))
    if question.property == "decomposition":
        return shape(descriptive.seasonality(rows, season), "strength", F.lit(None), F.lit("supported"))
    if question.property == "dependence":
        r = descriptive.correlations(windows.difference(rows)).withColumn("series", F.concat_ws("~", "series_a", "series_b"))
        label = F.when(F.col("r") > 0, "positive").otherwise("negative")
        return shape(r, "r", F.when(F.abs("r") >= 2 / F.sqrt("n"), label).otherwise("none"), F.when(F.abs("r") >= 2 / F.sqrt("n"), "supported").otherwise("weak"))
    if question.property == "seasonality":
        out = evidence.detect_season(rows, season)
        return shape(out, "strength", F.when(F.col("source") == "autocorrelation", "present").otherwise("uncertain"), F.when(F.col("source") == "autocorrelation", "supported").otherwise("weak"))
    out = evidence.supported(evidence.compared(rows, season)).where(F.col("property") == question.property)
    if question.scope == "aggregate":
        vote = evidence.consensus(out).withColumn("series", F.lit("*"))
        return shape(vote, "estimate", F.col("direction"), F.col("support"))
    return shape(out, "estimate", F.col("direction"), F.col("support"))


def property_paths(df: DataFrame, horizon: int, season: int = 1) -> DataFrame:
    """(series, kind, step, point) of simple continuations: last, median (of 48 rows), drift, damped_drift and seasonal.

    Drift is the slope of the last max(8, 2 season) rows; damped, each step adds 0.85 of the one before.
    """
    n = df.groupBy("series").agg(F.count("*").alias("n"))
    d = df.join(n, "series").withColumn("back", F.col("n") - F.col("idx"))
    wide = d.where(F.col("back") <= max(8, 2 * season)).groupBy("series").agg(F.coalesce(F.regr_slope("value", "idx"), F.lit(0.0)).alias("b"), F.max_by("value", "idx").alias("last"))
    mid = d.where("back <= 48").groupBy("series").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    steps = wide.join(mid, "series").withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    damped = (1 - F.pow(F.lit(0.85), F.col("step"))) / 0.15
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("point")) for k, x in (("last", F.col("last")), ("median", F.col("median")), ("drift", F.col("last") + F.col("b") * F.col("step")), ("damped_drift", F.col("last") + F.col("b") * damped))]))
    out = steps.select("series", "step", kinds.alias("k")).select("series", "k.kind", "step", "k.point")
    if season > 1:
        tail = d.where((F.col("back") <= season) & (F.col("n") >= 2 * season)).select("series", (season - F.col("back")).alias("phase"), "value")
        again = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long")))
        s = tail.withColumn("step", again).where((F.col("step") - 1) % season == F.col("phase"))
        out = out.unionByName(s.select("series", F.lit("seasonal").alias("kind"), "step", F.col("value").alias("point")))
    return out
