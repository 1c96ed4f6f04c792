"""What rests on what: claims, the evidence and artifacts they cite, and the checks that a claim must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Evidence that can carry a cause, and a probability: fixed values.
CAUSAL_KINDS = ("randomised_experiment", "natural_experiment")
CALIBRATION_KINDS = ("calibration", "evaluation")
BAND = (0.5, 0.99)


def edges(claims: DataFrame) -> DataFrame:
    """(source, target, relation): from each claim to what it cites."""
    cite = lambda c, r: claims.select(F.col("claim_id").alias("source"), F.explode(c).alias("target"), F.lit(r).alias("relation"))
    return cite("evidence_ids", "rests_on").unionByName(cite("artifact_ids", "derived_from"))


def violations(claims: DataFrame, evidence: DataFrame, artifacts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(claim_id, code) of claims (claim_id, claim_class, statement, subject, evidence_ids, artifact_ids, calibration_ref,
    constraints_evaluated) that break a rule, given evidence (evidence_id, kind, subject, coverage, fallback_rows) and
    artifacts (artifact_id, known_at).

    A claim that cites what does not exist is only told that. Causes need causal evidence; probabilities need a calibration
    whose measured coverage is believable; decisions need their constraints evaluated; nothing known after as_of may be cited;
    and a claim about a subject with fallback rows must say so and cite the evidence.
    """
    cited = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id"))
    sources = claims.select("claim_id", F.explode("artifact_ids").alias("artifact_id"))
    code = lambda df, name: df.select("claim_id", F.lit(name).alias("code")).distinct()
    dangling = code(cited.join(evidence, "evidence_id", "left_anti").select("claim_id").unionByName(sources.join(artifacts, "artifact_id", "left_anti").select("claim_id")), "DANGLING_REFERENCE")
    rest = claims.join(dangling, "claim_id", "left_anti")
    known = cited.join(evidence, "evidence_id").groupBy("claim_id").agg(F.bool_and(F.col("kind").isin(*CAUSAL_KINDS)).alias("causal"))
    causal = rest.where(F.col("claim_class").isin("causal", "counterfactual")).join(known, "claim_id", "left").where(~F.coalesce("causal", F.lit(False)))
    probable = rest.where("claim_class = 'predictive'").join(evidence.select(F.col("evidence_id").alias("calibration_ref"), F.col("kind").alias("_k"), "coverage"), "calibration_ref", "left")
    uncalibrated = probable.where(~F.coalesce(F.col("_k").isin(*CALIBRATION_KINDS), F.lit(False)))
    miscalibrated = probable.where(F.col("_k").isin(*CALIBRATION_KINDS) & ~F.col("coverage").between(*BAND))
    undecided = rest.where((F.col("claim_class") == "decision") & ~F.coalesce("constraints_evaluated", F.lit(False)))
    weak = evidence.where("fallback_rows > 0").groupBy("subject").agg(F.collect_set("evidence_id").alias("_weak"))
    said = F.lower("statement").rlike("best[_-]effort|naive extrapolation")
    unlabelled = rest.join(weak, "subject").where(~said | ~F.arrays_overlap("_weak", "evidence_ids"))
    out = dangling.unionByName(code(causal, "CAUSAL_FROM_ASSOCIATIONAL")).unionByName(code(uncalibrated, "UNCALIBRATED_PROBABILITY")).unionByName(code(miscalibrated, "MISCALIBRATED_PROBABILITY"))
    out = out.unionByName(code(undecided, "DECISION_CONSTRAINTS_UNEVALUATED")).unionByName(code(unlabelled, "SUB_SUPPORTED_UNLABELLED"))
    if as_of is not None:
        late = sources.join(rest.select("claim_id"), "claim_id", "left_semi").join(artifacts.where(F.col("known_at") > as_of), "artifact_id")
        out = out.unionByName(code(late, "TEMPORAL_LEAKAGE"))
    return out


def comparisons(asserted: DataFrame, measured: DataFrame) -> DataFrame:
    """Of (claim_id, evidence_id, metric, direction, threshold) and (evidence_id, metric, value): (claim_id, metric, problem)."""
    known = measured.select("evidence_id").distinct().withColumn("_e", F.lit(1))
    j = asserted.join(known, "evidence_id", "left").join(measured, ["evidence_id", "metric"], "left")
    v, t, d = F.col("value"), F.col("threshold"), F.col("direction")
    holds = F.when(d == "greater_than", v > t).when(d == "at_least", v >= t).when(d == "less_than", v < t).when(d == "at_most", v <= t)
    problem = F.when(F.col("_e").isNull(), "COMPARISON_EVIDENCE_MISSING").when(v.isNull(), "COMPARISON_UNMEASURED").when(holds.isNull(), "COMPARISON_UNKNOWN_DIRECTION").when(~holds, "COMPARISON_UNSUPPORTED")
    return j.withColumn("problem", problem).where("problem is not null").select("claim_id", "metric", "problem")
