"""The ledger of forecasts, proposals, effects and decisions: append-only rows, of which the latest wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import MAD_SCALE, TINY, median

Z80 = 1.2815515655446004


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: re-registering replaces. Ties go to the row of the largest values."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return best.select(*keys, "_r.*").select(rows.columns)


def newest(rows: DataFrame, order: str, limit: int, *ties: str) -> DataFrame:
    """The newest rows, at most `limit`: the feature is a top-k report."""
    return rows.orderBy(F.col(order).desc(), *ties).limit(limit)


def first_seen(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to insert where an existing key wins: new keys only, once each."""
    fresh = rows.join(stored.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(rows.columns)


def naive_errors(df: DataFrame, season: int) -> DataFrame:
    """(series, cutoff, naive_error): the mean absolute difference by the season, or by one row for series within one season."""
    w = Window.partitionBy("series").orderBy("idx")
    d = df.withColumn("_n", F.count("*").over(Window.partitionBy("series")))
    d = d.withColumn("_e", F.abs(F.col("value") - F.when(F.col("_n") > season, F.lag("value", season).over(w)).otherwise(F.lag("value").over(w))))
    return d.groupBy("series").agg(F.max("ts").alias("cutoff"), F.avg("_e").alias("naive_error"))


def due(forecasts: DataFrame, scored: DataFrame, now: Column) -> DataFrame:
    """(forecast_id, series, horizon_end, state) of unscored forecasts (forecast_id, series, ts): due or awaiting_horizon."""
    open_ = forecasts.join(scored.select("forecast_id", "series").distinct(), ["forecast_id", "series"], "left_anti")
    out = open_.groupBy("forecast_id", "series").agg(F.max("ts").alias("horizon_end"))
    return out.withColumn("state", F.when(F.col("horizon_end") <= now, "due").otherwise("awaiting_horizon"))


def unscored(forecasts: DataFrame, scored: DataFrame, actuals: DataFrame) -> DataFrame:
    """(forecast_id, series, first_ts, last_ts, required, supplied, reason) of every open forecast."""
    open_ = forecasts.join(scored.select("forecast_id", "series").distinct(), ["forecast_id", "series"], "left_anti")
    have = actuals.select("series", "ts").distinct().withColumn("_h", F.lit(1))
    out = open_.join(have, ["series", "ts"], "left").groupBy("forecast_id", "series").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("required"), F.count("_h").alias("supplied"))
    return out.withColumn("reason", F.when(F.col("supplied") == 0, "no overlap").when(F.col("supplied") < F.col("required"), "partial overlap").otherwise("ready"))


def comparisons(scores: DataFrame, keys: tuple[str, ...] = ("series", "horizon", "frequency", "cutoff")) -> DataFrame:
    """Pairs of neighbouring forecasts (by id) that share all keys: (..., a, b, mase_a, mase_b, winner).

    Each meets the next of its key rather than all others.
    """
    w = Window.partitionBy(*keys).orderBy("forecast_id")
    out = scores.select(*keys, F.col("forecast_id").alias("a"), F.col("mase").alias("mase_a"), F.lead("forecast_id").over(w).alias("b"), F.lead("mase").over(w).alias("mase_b")).where("b is not null")
    return out.withColumn("winner", F.when(F.col("mase_a").isNotNull() & F.col("mase_b").isNotNull(), F.when(F.col("mase_a") < F.col("mase_b"), "a").otherwise("b")))


def known_time(outcomes: DataFrame, keys: list[str], submitted: Column) -> DataFrame:
    """(keys, known_at): the latest knowledge time where all outcomes have one, else the time of submission."""
    return outcomes.groupBy(*keys).agg(F.when(F.count("known_at") == F.count("*"), F.max("known_at")).otherwise(submitted).alias("known_at"))


def performance_as_of(scores: DataFrame, as_of: Column) -> DataFrame:
    """(model, n, mase, last_mase) of scores known by a time."""
    return scores.where(F.col("known_at") <= as_of).groupBy("model").agg(F.count("*").alias("n"), F.avg("mase").alias("mase"), F.max_by("mase", F.struct("known_at", "forecast_id")).alias("last_mase"))


def status(forecasts: DataFrame, scored: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """One row: open and due forecasts, unresolved decisions, and the mean regret of the resolved."""
    d = due(forecasts, scored, now).agg(F.count("*").alias("open"), F.count_if(F.col("state") == "due").alias("due"))
    r = decisions.agg(F.count_if(F.col("regret").isNull()).alias("unresolved"), F.avg("regret").alias("mean_regret"))
    return d.crossJoin(r)


def proposal_outcomes(proposals: DataFrame, admissions: DataFrame, outcomes: DataFrame, keys: tuple[str, ...] = ("forecast_id", "series", "proposal_key")) -> DataFrame:
    """(proposer, event_type, proposals, admitted, published, resolved, mean_lift, shrunk_lift, shrunk_hit_rate)."""
    k, by = 10, ["proposer", "event_type"]
    j = proposals.join(admissions, list(keys), "left").join(outcomes, list(keys), "left")
    flag = lambda c: F.sum(F.coalesce(F.col(c).cast("int"), F.lit(0)))
    a = j.groupBy(*by).agg(F.count("*").alias("proposals"), flag("admitted").alias("admitted"), flag("published").alias("published"), F.count("lift").alias("resolved"), F.sum("lift").alias("s"), F.sum(F.col("hit").cast("int")).alias("hits"), F.count("hit").alias("calls"))
    s, hits = F.coalesce("s", F.lit(0.0)), F.coalesce("hits", F.lit(0))
    return a.select(*by, "proposals", "admitted", "published", "resolved", F.try_divide(F.col("s"), F.col("resolved")).alias("mean_lift"), (s / (F.col("resolved") + k)).alias("shrunk_lift"), ((hits + k / 2) / (F.col("calls") + k)).alias("shrunk_hit_rate"))


def realised_lift(rows: DataFrame) -> DataFrame:
    """Of (forecast_id, series, actual, published, counterfactual): WAPE without less WAPE with what was published."""
    total = F.sum(F.abs("actual"))
    wape = lambda c: F.when(total > TINY, F.sum(F.abs(F.col("actual") - F.col(c))) / total)
    out = rows.groupBy("forecast_id", "series").agg(wape("counterfactual").alias("base_wape"), wape("published").alias("published_wape"))
    return out.withColumn("lift", F.col("base_wape") - F.col("published_wape"))


def effect_estimates(rows: DataFrame) -> DataFrame:
    """Of (effect_id, series, step, actual, primary, scenario): the realised effect on the steps that the scenario moves.

    The mean error of the other steps is taken off as bias; with a standard error and an 80 % interval, onset and duration in
    steps, and the shape: a trend where the slope over the active steps is half of the level, a pulse where the last is under
    half of the first. Scenarios of a series that move the same step are confounded.
    """
    moved = F.abs(F.col("primary") - F.col("scenario")) > F.greatest(F.lit(1e-12) * F.greatest(F.abs("primary"), F.abs("scenario")), F.lit(1e-12))
    d = rows.withColumn("on", moved).withColumn("e", F.col("actual") - F.col("primary")).withColumn("sharing", F.count_if(moved).over(Window.partitionBy("series", "step")))
    key = ["effect_id", "series"]
    off = F.when(~F.col("on"), F.col("e"))
    base = d.groupBy(*key).agg(F.coalesce(F.avg(off), F.lit(0.0)).alias("bias"), F.var_samp(off).alias("v0"), F.count(off).alias("n0"), F.max(F.when(F.col("on"), F.col("sharing"))).alias("most"))
    order = Window.partitionBy(*key).orderBy("step")
    a = d.where("on").join(base, key).withColumn("r", F.col("e") - F.col("bias")).withColumn("i", F.row_number().over(order) - 1)
    a = a.withColumn("c", F.percentile("r", F.lit(0.5)).over(Window.partitionBy(*key)))
    a = a.withColumn("noise", F.percentile(F.abs(F.col("r") - F.col("c")), F.lit(0.5)).over(Window.partitionBy(*key)) * MAD_SCALE)
    seen = F.abs("r") >= F.greatest("noise", F.abs("c") * 0.1, F.lit(TINY))
    s = a.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.avg("r").alias("estimate"),
        F.var_samp("r").alias("v1"),
        F.first("bias").alias("bias"),
        F.first("v0").alias("v0"),
        F.first("n0").alias("n0"),
        F.first("most").alias("sharing"),
        F.first("c").alias("c"),
        F.first("noise").alias("noise"),
        F.min(F.when(seen, F.col("i"))).alias("onset"),
        F.max(F.when(seen, F.col("i"))).alias("last_seen"),
        F.regr_slope("r", "i").alias("slope"),
        F.min_by("r", "i").alias("r_first"),
        F.max_by("r", "i").alias("r_last"),
    )
    c = F.col
    se = F.when(c("n") >= 2, F.sqrt(c("v1") / c("n") + F.when(c("n0") >= 2, c("v0") / c("n0")).otherwise(0.0)))
    level = F.greatest(F.abs("c"), c("noise"), F.lit(TINY))
    shape = F.when(c("n") < 3, "unknown").when(F.abs("slope") * c("n") >= 0.5 * level, "trend_change").when(F.abs("r_last") < 0.5 * F.abs("r_first"), "temporary_pulse").otherwise("level_shift")
    s = s.withColumn("se", se).withColumn("shape", shape)
    return s.select(*key, "n", "estimate", "bias", "se", (c("estimate") - Z80 * c("se")).alias("low"), (c("estimate") + Z80 * c("se")).alias("high"), c("onset").cast("long").alias("onset"), (c("last_seen") - c("onset") + 1).cast("long").alias("duration"), "shape", (c("sharing") > 1).alias("confounded"))


def pooled_priors(effects: DataFrame, shrink: int = 3, least: int = 5) -> DataFrame:
    """Of confirmed effects (event_type, series, estimate, se): a prior for every series of a type.

    The series' mean is shrunk towards the type's by `shrink` imagined effects. Leaving each effect out, the prior of the rest
    must miss it by less than no effect would, on `least` effects at least. The half width is the larger of the 80 % normal
    and the conformal one of the errors left out.
    """
    t, ts = Window.partitionBy("event_type"), Window.partitionBy("event_type", "series")
    c = F.col
    d = effects.withColumn("n", F.count("*").over(t)).withColumn("s", F.sum("estimate").over(t)).withColumn("m", F.count("*").over(ts)).withColumn("u", F.sum("estimate").over(ts))
    others = (c("s") - c("estimate")) / (c("n") - 1)
    own = F.when(c("m") > 1, (c("u") - c("estimate")) / (c("m") - 1))
    weight = (c("m") - 1) / (c("m") - 1 + shrink)
    d = d.withColumn("loo", F.when(c("n") > 1, F.coalesce(weight * own + (1 - weight) * others, others)))
    d = d.withColumn("err", F.abs(c("estimate") - c("loo")))
    errors = F.array_sort(F.collect_list("err"))
    p = d.groupBy("event_type").agg(F.count("err").alias("episodes"), F.avg("err").alias("mae"), F.avg(F.when(c("err").isNotNull(), F.abs("estimate"))).alias("zero"), F.coalesce(F.var_samp("estimate"), F.lit(0.0)).alias("between"), F.avg(F.pow(F.coalesce("se", F.lit(0.0)), 2)).alias("within"), F.avg("estimate").alias("type_mean"), errors.alias("errors"))
    rank = F.least(F.size("errors"), F.ceil((F.size("errors") + 1) * F.lit(0.8)).cast("int"))
    p = p.withColumn("half", F.greatest(Z80 * F.sqrt(c("between") + c("within")), F.coalesce(F.get("errors", rank - 1), F.lit(0.0))))
    local = d.groupBy("event_type", "series").agg(F.avg("estimate").alias("local"), F.count("*").alias("local_n"))
    x = local.join(p, "event_type")
    w = c("local_n") / (c("local_n") + shrink)
    x = x.withColumn("effect", w * c("local") + (1 - w) * c("type_mean"))
    ok = (c("episodes") >= least) & (c("mae") < c("zero"))
    return x.select("event_type", "series", "local_n", "episodes", "effect", (c("effect") - c("half")).alias("low"), (c("effect") + c("half")).alias("high"), F.coalesce(ok, F.lit(False)).alias("validated"))


def shadow(outcomes: DataFrame, least: int = 30, gain: float = 0.05, wins: float = 0.6) -> DataFrame:
    """Of (candidate, baseline, candidate_error, baseline_error): whether the candidate may be promoted, and why not."""
    g = F.when(F.col("baseline_error") > TINY, (F.col("baseline_error") - F.col("candidate_error")) / F.col("baseline_error"))
    a = outcomes.groupBy("candidate", "baseline").agg(F.count("*").alias("n"), F.avg(g).alias("improvement"), F.avg((F.col("candidate_error") < F.col("baseline_error")).cast("int")).alias("win_rate"))
    why = F.array_compact(F.array(F.when(F.col("n") < least, "insufficient_paired_outcomes"), F.when(F.coalesce(F.col("improvement") < gain, F.lit(True)), "mean_improvement_below_gate"), F.when(F.coalesce(F.col("win_rate") < wins, F.lit(True)), "win_rate_below_gate")))
    return a.withColumn("reasons", F.concat_ws(",", why)).withColumn("promote", F.size(why) == 0)


def pooled_gain(estimates: DataFrame) -> DataFrame:
    """Of (key, gain, se): the precision-weighted mean, its error, and the candidate's weight 2 P(gain > 0) - 1, not below 0.

    P is that of a normal distribution, by an approximation of the error function to 1.5e-7.
    """
    a = estimates.groupBy("key").agg(F.sum(F.col("gain") / F.pow("se", F.lit(2))).alias("s"), F.sum(1 / F.pow("se", F.lit(2))).alias("p"))
    a = a.select("key", (F.col("s") / F.col("p")).alias("gain"), F.sqrt(1 / F.col("p")).alias("se"))
    return a.withColumn("weight", F.greatest(2 * normal_cdf(F.col("gain") / F.col("se")) - 1, F.lit(0.0)))


def normal_cdf(z: Column) -> Column:
    """The distribution function of the normal distribution, after Abramowitz and Stegun 7.1.26."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * erf)


def registry_match(queries: DataFrame, registry: DataFrame, dimensions: list[str]) -> DataFrame:
    """Of queries (query_id, model, dimensions) and a registry of the same with '*' for any: the most specific match.

    (query_id, entry_id, specificity, ambiguous); registry rows meet by their model. Ties are marked ambiguous.
    """
    r = registry.select("entry_id", "model", *[F.col(c).alias(f"_{c}") for c in dimensions])
    fits, score = F.lit(True), F.lit(0)
    for c in dimensions:
        fits = fits & ((F.col(f"_{c}") == "*") | (F.col(f"_{c}") == F.col(c)))
        score = score + (F.col(f"_{c}") != "*").cast("int")
    m = queries.join(r, "model").where(fits).withColumn("specificity", score)
    w = Window.partitionBy("query_id")
    m = m.withColumn("top", F.max("specificity").over(w)).where("specificity = top")
    return m.groupBy("query_id").agg(F.min("entry_id").alias("entry_id"), F.max("specificity").cast("long").alias("specificity"), (F.count("*") > 1).alias("ambiguous"))


def access_summary(reads: DataFrame) -> DataFrame:
    """(entity, variable, reads, known_at): how often each was read, and the latest knowledge it saw."""
    return reads.groupBy("entity", "variable").agg(F.count("*").alias("reads"), F.max("known_at").alias("known_at"))


def dataset_identity(store: DataFrame, keys: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """(keys, rows, known_at, identity): changes whenever a vintage is added."""
    a = store.groupBy(*keys).agg(F.count("*").alias("rows"), F.max("known").alias("known_at"), F.max("revision").alias("_r"))
    return a.select(*keys, "rows", "known_at", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("rows").cast("string"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(known_at as timestamp_ntz))").cast("string"), F.col("_r").cast("string")), 256).alias("identity"))


def provenance(store: DataFrame, ingests: DataFrame) -> DataFrame:
    """Of a store (series, ingest_id) and ingests (ingest_id, known_time: recorded or assumed): how each series knows its times."""
    used = ingests.join(store.select("ingest_id").distinct(), "ingest_id", "left_semi")
    kinds = store.select("series", "ingest_id").distinct().join(used, "ingest_id").groupBy("series").agg(F.array_sort(F.collect_set("known_time")).alias("k"))
    return kinds.select("series", F.when(F.size("k") > 1, "partially_assumed").otherwise(F.get("k", F.lit(0))).alias("known_time"))


def paired_runs(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """Of runs (task_id, success, voided) with identical tasks: rates, the discordant pairs and the uplift, one row.

    A task voided in either run counts in neither. `unmatched` is how many tasks only one of them has.
    """
    a = baseline.select("task_id", F.col("success").alias("s0"), F.col("voided").alias("v0"), F.lit(1).alias("h0"))
    b = treatment.select("task_id", F.col("success").alias("s1"), F.col("voided").alias("v1"), F.lit(1).alias("h1"))
    j = a.join(b, "task_id", "full").withColumn("ok", F.col("h0").isNotNull() & F.col("h1").isNotNull() & ~F.coalesce(F.col("v0") | F.col("v1"), F.lit(False)))
    rate = lambda c: F.avg(F.when(F.col("ok"), F.col(c).cast("int")))
    out = j.agg(F.count("*").alias("tasks"), F.count_if(F.col("h0").isNull() | F.col("h1").isNull()).alias("unmatched"), F.count_if("ok").alias("graded"), rate("s0").alias("baseline"), rate("s1").alias("treatment"), F.count_if(F.col("ok") & F.col("s1") & ~F.col("s0")).alias("won"), F.count_if(F.col("ok") & F.col("s0") & ~F.col("s1")).alias("lost"))
    return out.withColumn("uplift", F.col("treatment") - F.col("baseline"))


def pass_rates(runs: DataFrame) -> DataFrame:
    """Of (task_id, attempt, success): per task the share of passes and whether all pass; null successes are not measured."""
    return runs.groupBy("task_id").agg(F.count("success").alias("measured"), F.avg(F.col("success").cast("int")).alias("rate"), F.bool_and("success").alias("pass_all"))


def route_prior(performance: DataFrame, prints: DataFrame, least: int = 10) -> DataFrame:
    """Of (model, series, mase) and (series, distance) to the series in question: models ranked by means weighted 1 / (1 + d).

    Models with fewer than `least` records in all are not ranked.
    """
    j = performance.where("mase is not null").join(prints, "series").withColumn("w", 1 / (1 + F.col("distance")))
    a = j.groupBy("model").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("mase")) / F.sum("w")).alias("score")).where(F.col("n") >= least)
    return a.withColumn("rank", F.row_number().over(Window.orderBy("score", "model")).cast("long"))
