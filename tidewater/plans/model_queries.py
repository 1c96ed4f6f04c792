"""Queries of the models, questions, lineage, quality and decision operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import histories
from ..functions.parsing import parse_time
from ..functions.stats import nearest_rank
from ..operators import anomalies, context, decisions, evaluate, lineage, multivariate, quality, questions
from ..sources.readers import wide_to_long
from ..sources.sinks import redacted
from .catalogue import CHOSEN, DAYS, FOLDS, HOURS, H, LINEAR, ORDER_DAYS, SEASON, days, hours, order_days, query, rounded
from .evidence_queries import DIFFS, SUPPORT, _compared
from .ledger_queries import table


@query("graded_detection")
def _(spark, d):
    return rounded(anomalies.detected(hours(spark, d), 24), 4)


@query("label_detection")
def _(spark, d):
    s = hours(spark, d)
    return rounded(anomalies.detected(s, 24, labels=s.where("idx % 97 = 50").select("series", "idx")), 4)


@query("var_forecast")
def _(spark, d):
    # A wave that all series share, so that they are worth a common model.
    wave = days(spark, d).withColumn("panel", F.lit("events")).withColumn("value", F.col("value") + 1000 * F.sin(F.col("idx").cast("double")))
    return rounded(multivariate.var_forecast(wave, H))


@query("covariate_forecast")
def _(spark, d):
    turn = 2 * F.pi() * F.col("idx") / 7
    s = days(spark, d).withColumn("wave", F.sin(turn)).withColumn("load", F.cos(turn))
    ahead = s.groupBy("series").agg(F.max("idx").alias("n")).withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(H).cast("long"))))
    turn = 2 * F.pi() * (F.col("n") + F.col("step")) / 7
    return rounded(multivariate.covariate_forecast(s, ahead.withColumn("wave", F.sin(turn)).withColumn("load", F.cos(turn)), ["wave", "load"], SEASON))


@query("exogenous_regression")
def _(spark, d):
    s = hours(spark, d).withColumn("day", F.sin(2 * F.pi() * F.col("idx") / 24)).withColumn("week", F.cos(2 * F.pi() * F.col("idx") / 168))
    return rounded(multivariate.regression(s, "value", ["day", "week"]))


@query("stacked_forecast")
def _(spark, d):
    bt = evaluate.backtest(days(spark, d), H, SEASON, LINEAR)
    return rounded(multivariate.stacked(bt, multivariate.stacking_weights(bt)))


@query(
    "blended_forecast",
    f"WITH {FOLDS} SELECT series, origin, role, lead, round(any_value(actual), 6) AS actual, round(.3 * max(predicted) FILTER (model = 'drift') + .7 * max(predicted) FILTER (model = 'seasonal_naive'), 6) AS blended FROM bt GROUP BY series, origin, role, lead",
)
def _(spark, d):
    return rounded(multivariate.blended(evaluate.backtest(days(spark, d), H, SEASON, LINEAR), "drift", "seasonal_naive", 0.3))


@query(
    "property_paths",
    f"""WITH {DAYS}, n AS (SELECT *, count(*) OVER (PARTITION BY series) - idx AS back FROM s), g AS (SELECT series, regr_slope(value, idx) FILTER (back <= 14) AS b, arg_max(value, idx) AS last, median(value) FILTER (back <= 48) AS m FROM n GROUP BY series), k AS (SELECT unnest(range(1, 6)) AS step)
    SELECT series, kind, step, round(CASE kind WHEN 'last' THEN last WHEN 'median' THEN m WHEN 'drift' THEN last + b * step ELSE last + b * (1 - power(.85, step)) / .15 END, 6) AS point FROM g, k, (VALUES ('last'), ('median'), ('drift'), ('damped_drift')) t(kind) UNION ALL SELECT series, 'seasonal', step, round(value, 6) FROM n, k WHERE back <= 7 AND (step - 1) % 7 = 7 - back""",
)
def _(spark, d):
    return rounded(questions.property_paths(days(spark, d), 5, 7))


@query("answered_level", f"WITH {HOURS}, {DIFFS}, {_compared('48', 24)} SELECT series, property, round(estimate, 5) AS value, direction, {SUPPORT} AS support FROM cmp WHERE property = 'level' AND series IN ('click', 'view')")
def _(spark, d):
    s = hours(spark, d)
    q = questions.compiled({"verb": "compare", "property": "average", "target": {"kind": "each", "members": ["click", "view"]}, "period": 24}, [r["series"] for r in s.select("series").distinct().collect()])
    return rounded(questions.answered(s, q), 5)


@query(
    "answered_dependence",
    f"WITH {DAYS}, f AS (SELECT series, ts, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS v FROM s), x AS (SELECT corr(a.v, b.v) AS r, count(*) AS n FROM f a JOIN f b ON a.ts = b.ts AND a.series = 'click' AND b.series = 'view' WHERE a.v IS NOT NULL AND b.v IS NOT NULL) SELECT 'click~view' AS series, 'dependence' AS property, round(r, 6) AS value, CASE WHEN abs(r) < 2 / sqrt(n) THEN 'none' WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs(r) >= 2 / sqrt(n) THEN 'supported' ELSE 'weak' END AS support FROM x",
)
def _(spark, d):
    q = questions.compiled({"verb": "describe", "property": "relationship", "target": {"kind": "pair", "members": ["click", "view"]}}, ["click", "view"])
    return rounded(questions.answered(days(spark, d), q))


CLAIMS = """cl AS (SELECT o_orderkey AS claim_id, CASE o_orderkey % 4 WHEN 0 THEN 'predictive' WHEN 1 THEN 'causal' WHEN 2 THEN 'decision' ELSE 'descriptive' END AS cls, o_custkey AS subject, o_custkey AS e, o_orderkey % 1700 AS a, o_orderkey % 5 = 0 AS said, o_orderkey % 3 = 0 AS done FROM orders),
    ev AS (SELECT c_custkey AS e, CASE c_custkey % 3 WHEN 0 THEN 'calibration' WHEN 1 THEN 'natural_experiment' ELSE 'association' END AS kind, c_custkey AS subject, (c_custkey % 100) / 100 AS coverage, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS fb FROM customer WHERE c_custkey % 10 <> 0), ar AS (SELECT p_partkey AS a, p_size AS known FROM part)"""


def claims(spark, d):
    k = F.col("o_orderkey")
    cls = F.when(k % 4 == 0, "predictive").when(k % 4 == 1, "causal").when(k % 4 == 2, "decision").otherwise("descriptive")
    cl = table(spark, d, "orders").select(k.alias("claim_id"), cls.alias("claim_class"), F.when(k % 5 == 0, "a naive extrapolation").otherwise("a forecast").alias("statement"), F.col("o_custkey").alias("subject"), F.array("o_custkey").alias("evidence_ids"), F.array(k % 1700).alias("artifact_ids"), F.col("o_custkey").alias("calibration_ref"), (k % 3 == 0).alias("constraints_evaluated"))
    c = F.col("c_custkey")
    kind = F.when(c % 3 == 0, "calibration").when(c % 3 == 1, "natural_experiment").otherwise("association")
    ev = table(spark, d, "customer").where(c % 10 != 0).select(c.alias("evidence_id"), kind.alias("kind"), c.alias("subject"), ((c % 100) / 100).alias("coverage"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("fallback_rows"))
    return cl, ev, table(spark, d, "part").select(F.col("p_partkey").alias("artifact_id"), F.col("p_size").alias("known_at"))


@query(
    "claim_violations",
    f"""WITH {CLAIMS}, dg AS (SELECT claim_id FROM cl WHERE e NOT IN (SELECT e FROM ev) OR a NOT IN (SELECT a FROM ar)), r AS (SELECT cl.*, ev.kind, ev.coverage, ev.fb, ar.known FROM cl JOIN ev USING (e) JOIN ar USING (a))
    SELECT claim_id, 'DANGLING_REFERENCE' AS code FROM dg UNION ALL SELECT claim_id, 'CAUSAL_FROM_ASSOCIATIONAL' FROM r WHERE cls = 'causal' AND kind <> 'natural_experiment' UNION ALL SELECT claim_id, 'UNCALIBRATED_PROBABILITY' FROM r WHERE cls = 'predictive' AND kind <> 'calibration'
    UNION ALL SELECT claim_id, 'MISCALIBRATED_PROBABILITY' FROM r WHERE cls = 'predictive' AND kind = 'calibration' AND coverage NOT BETWEEN .5 AND .99 UNION ALL SELECT claim_id, 'DECISION_CONSTRAINTS_UNEVALUATED' FROM r WHERE cls = 'decision' AND NOT done
    UNION ALL SELECT claim_id, 'SUB_SUPPORTED_UNLABELLED' FROM r WHERE fb > 0 AND NOT said UNION ALL SELECT claim_id, 'TEMPORAL_LEAKAGE' FROM r WHERE known > 40""",
)
def _(spark, d):
    return lineage.violations(*claims(spark, d), as_of=F.lit(40))


@query("lineage_edges", f"WITH {CLAIMS} SELECT claim_id AS source, e AS target, 'rests_on' AS relation FROM cl UNION ALL SELECT claim_id, a, 'derived_from' FROM cl")
def _(spark, d):
    return lineage.edges(claims(spark, d)[0])


@query(
    "claim_comparisons",
    "WITH a AS (SELECT l_orderkey AS claim_id, l_partkey AS e, CASE l_linenumber % 3 WHEN 0 THEN 'at_least' WHEN 1 THEN 'less_than' ELSE 'near' END AS direction, l_quantity AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'size' ELSE 'weight' END AS metric FROM lineitem), m AS (SELECT p_partkey AS e, p_size AS v FROM part WHERE p_partkey % 7 <> 0) SELECT claim_id, metric, CASE WHEN m.e IS NULL THEN 'COMPARISON_EVIDENCE_MISSING' WHEN metric = 'weight' THEN 'COMPARISON_UNMEASURED' WHEN direction = 'near' THEN 'COMPARISON_UNKNOWN_DIRECTION' ELSE 'COMPARISON_UNSUPPORTED' END AS problem FROM a LEFT JOIN m USING (e) WHERE NOT coalesce(metric = 'size' AND ((direction = 'at_least' AND v >= t) OR (direction = 'less_than' AND v < t)), false)",
)
def _(spark, d):
    n = F.col("l_linenumber")
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("evidence_id"), F.when(n % 3 == 0, "at_least").when(n % 3 == 1, "less_than").otherwise("near").alias("direction"), F.col("l_quantity").alias("threshold"), F.when(n % 2 == 0, "size").otherwise("weight").alias("metric"))
    m = table(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("evidence_id"), F.lit("size").alias("metric"), F.col("p_size").cast("double").alias("value"))
    return lineage.comparisons(a, m)


@query(
    "named_frequencies",
    f"WITH {ORDER_DAYS} SELECT 'months' AS series, 'MS' AS frequency, NULL::VARCHAR AS problem UNION ALL SELECT 'weeks', 'W', NULL UNION ALL SELECT 'odd', '7h', NULL UNION ALL SELECT 'two', NULL, 'at least three times are needed' UNION ALL SELECT 'orders', 'D', NULL",
)
def _(spark, d):
    s = order_days(spark, d).select("series", F.col("ts").cast("timestamp_ntz").alias("ts"))
    k = spark.range(40).select(F.col("id").cast("int").alias("k"))
    base = F.lit("2024-01-01").cast("date")
    months = k.where("k <> 5").select(F.lit("months").alias("series"), F.add_months(base, F.col("k")).cast("timestamp_ntz").alias("ts"))
    weeks = k.where("k <> 7").select(F.lit("weeks").alias("series"), F.date_add(base, F.col("k") * 7).cast("timestamp_ntz").alias("ts"))
    odd = k.select(F.lit("odd").alias("series"), F.timestamp_add("HOUR", F.col("k") * 7, base.cast("timestamp_ntz")).alias("ts"))
    two = k.where("k < 2").select(F.lit("two").alias("series"), F.date_add(base, F.col("k")).cast("timestamp_ntz").alias("ts"))
    return quality.named_step(s.unionByName(months).unionByName(weeks).unionByName(odd).unionByName(two))


GAPS = f"{ORDER_DAYS}, g AS (SELECT series, ts, lead(ts) OVER (ORDER BY ts) AS nt, lead(ts) OVER (ORDER BY ts) - ts - 1 AS m FROM s)"


@query("grid_problems", f"WITH {GAPS}, b AS (SELECT *, dayofweek(ts) = 5 AND m = 2 AS we FROM g WHERE m > 0) SELECT series, ts, nt AS next_ts, CASE WHEN we THEN 'weekend' ELSE 'irregular' END AS problem FROM b ORDER BY we, ts LIMIT 1")
def _(spark, d):
    return quality.grid_problems(order_days(spark, d), "D")


@query("fill_refusals", f"WITH {GAPS}, a AS (SELECT series, count(*) AS n, coalesce(max(m), 0) AS longest, CAST(coalesce(sum(m), 0) AS BIGINT) AS filled FROM g GROUP BY series) SELECT *, CASE WHEN longest > greatest(3, n // 10) THEN 'gap_run' WHEN filled / n > .3 THEN 'filled_share' END AS problem FROM a")
def _(spark, d):
    return rounded(quality.fill_refusals(order_days(spark, d)))


@query("regrid_refusals", f"WITH {GAPS}, a AS (SELECT series, count(*) AS n, coalesce(max(m), 0) AS longest, CAST(coalesce(sum(m), 0) AS BIGINT) AS filled FROM g GROUP BY series) SELECT series, longest, filled, round(filled / (n + filled), 6) AS share, CASE WHEN longest > 10 THEN 'fill_run' WHEN filled / (n + filled) > .45 THEN 'fill_share' END AS problem FROM a")
def _(spark, d):
    return rounded(quality.regrid_refusals(order_days(spark, d)))


@query("month_conflicts", "SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return quality.month_conflicts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")))


CELLS = "x AS (SELECT l_returnflag || l_linestatus AS series, CAST(l_shipdate AS DATE) AS ts, floor(l_quantity / 20) AS value, l_orderkey * 10 + l_linenumber AS n FROM lineitem)"


def cells(spark, d):
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("series"), F.to_date("l_shipdate").alias("ts"), F.floor(F.col("l_quantity") / 20).cast("double").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_row_no"))


@query("repaired_rows", f"WITH {CELLS} SELECT series, ts, arg_max(value, n) AS value FROM x GROUP BY series, ts")
def _(spark, d):
    return quality.repaired(cells(spark, d), "aggressive")[0]


@query("repair_log", f"WITH {CELLS}, a AS (SELECT series, count(*) AS n, count(DISTINCT value) AS k FROM x GROUP BY series, ts) SELECT series, 'duplicate_row_collapsed' AS code, CAST(sum(n - k) AS BIGINT) AS count, false AS assumptive FROM a GROUP BY series HAVING sum(n - k) > 0 UNION ALL SELECT series, 'conflicting_duplicate_resolved', CAST(sum(k - 1) AS BIGINT), true FROM a GROUP BY series HAVING sum(k - 1) > 0")
def _(spark, d):
    return quality.repaired(cells(spark, d), "aggressive")[1]


@query(
    "coerced_times",
    "SELECT event_id, CASE event_id % 3 WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS ts, event_id % 3 = 0 AS assumed FROM events",
)
def _(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 3
    # Formatted from parts, so that the session's zone does not matter.
    text = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    cell = F.when(k == 0, text).when(k == 1, F.concat(text, F.lit("+02:00"))).otherwise(F.concat(text, F.lit("Z")))
    return quality.coerced(e.select("event_id", cell.alias("cell")), "cell").select("event_id", "ts", "assumed")


@query(
    "parse_table_times",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) ELSE date_trunc('day', ts) END AS ts FROM events",
)
def _(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    f = lambda p: F.date_format("ts", p)
    cell = F.when(k == 0, f("yyyy/MM/dd HH:mm:ss")).when(k == 1, f("yyyy/MM/dd HH:mm")).when(k == 2, f("d MMM yyyy")).otherwise(f("yyyyMMdd"))
    return e.select("event_id", parse_time(cell).alias("ts"))


@query("redacted_text", "SELECT c_custkey, 'see [EMAIL] at [URL] key token=[REDACTED] in [PATH]' AS t FROM customer")
def _(spark, d):
    i = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("see  user"), i, F.lit("@mail.example.org at https://x.example.org/a?b="), i, F.lit(" key token: abc"), i, F.lit("\n in /home/u"), i, F.lit("/f.txt"))
    return table(spark, d, "customer").select("c_custkey", redacted(text).alias("t"))


@query("wide_to_long", "SELECT CAST(l_orderkey AS VARCHAR) || '/quantity' AS series, l_shipdate AS ts, l_quantity AS value FROM lineitem UNION ALL SELECT CAST(l_orderkey AS VARCHAR) || '/tax', l_shipdate, l_tax FROM lineitem")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return wide_to_long(x, "l_shipdate", ["quantity", "tax"], "l_orderkey")


ACTIONS = "a AS (SELECT p_brand AS action, p_type AS scenario, avg(p_retailprice) / 1000 - 1.4 AS utility, count(*) AS n, min(p_size) > 1 AS feasible FROM part GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY action) AS p FROM a)"


def actions(spark, d):
    from pyspark.sql import Window

    a = table(spark, d, "part").groupBy(F.col("p_brand").alias("action"), F.col("p_type").alias("scenario")).agg((F.avg("p_retailprice") / 1000 - 1.4).alias("utility"), F.count("*").alias("n"), (F.min("p_size") > 1).alias("feasible"))
    return a.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("action")))


@query("expected_utility_of_parts", f"WITH {ACTIONS} SELECT action, round(sum(p * utility), 6) AS utility, round(sum(p), 6) AS p, row_number() OVER (ORDER BY sum(p * utility) DESC, action) AS rank FROM t GROUP BY action")
def _(spark, d):
    return rounded(decisions.expected_utility(actions(spark, d)))


@query("maximin_of_parts", f"WITH {ACTIONS} SELECT action, round(min(utility), 6) AS worst, round(avg(utility), 6) AS mean, row_number() OVER (ORDER BY min(utility) DESC, avg(utility) DESC, action) AS rank FROM t GROUP BY action")
def _(spark, d):
    return rounded(decisions.maximin(actions(spark, d)))


@query("regret_of_parts", f"WITH {ACTIONS} SELECT action, scenario, round(max(utility) FILTER (feasible) OVER (PARTITION BY scenario) - utility, 6) AS regret FROM t")
def _(spark, d):
    return rounded(decisions.regret(actions(spark, d)).select("action", "scenario", "regret"))


@query(
    "evaluated_actions",
    f"WITH {ACTIONS}, g AS (SELECT action, bool_and(feasible) AS f, sum(p * utility) AS u FROM t GROUP BY action), r AS (SELECT action, row_number() OVER (ORDER BY u DESC, action) AS k FROM g WHERE f) SELECT action, CASE WHEN f THEN 'evaluated' ELSE 'infeasible' END AS status, round(u, 6) AS utility, k AS rank FROM g LEFT JOIN r USING (action)",
)
def _(spark, d):
    return rounded(decisions.evaluated_actions(actions(spark, d)))


@query(
    "pinball_scores",
    f"WITH {CHOSEN}, re AS (SELECT series, actual - predicted AS e FROM bt JOIN ch USING (series, model) WHERE role <> 'test'), p AS (SELECT series, list_sort(list(e)) AS x FROM re GROUP BY series), t AS (SELECT bt.series, actual, predicted FROM bt JOIN ch USING (series, model) WHERE role = 'test'), l(q) AS (VALUES (0.1::DOUBLE), (0.5), (0.9)), y AS (SELECT t.series, q, actual - predicted - x[CASE WHEN q >= .5 THEN least(CAST(ceil((len(x) + 1) * q) AS BIGINT), len(x)) ELSE greatest(CAST(floor((len(x) + 1) * q) AS BIGINT), 1) END] AS d FROM t JOIN p USING (series), l) SELECT series, q AS level, round(avg(CASE WHEN d >= 0 THEN q * d ELSE (q - 1) * d END), 6) AS loss FROM y GROUP BY series, q",
)
def _(spark, d):
    bt = evaluate.backtest(days(spark, d), H, SEASON, LINEAR)
    chosen = evaluate.select_model(evaluate.fold_scores(bt))
    return rounded(evaluate.pinball_scores(bt, chosen, evaluate.spreads(evaluate.residuals(bt, chosen)), (0.1, 0.5, 0.9)))


@query("dense_origins", f"WITH {HOURS}, n AS (SELECT series, count(*) AS n FROM s GROUP BY series), l AS (SELECT series, 48 + ((n - 24 - 48) // 24 + 1 - 3) * 24 AS last FROM n) SELECT series, unnest(range(48, last + 1, 7)) AS origin FROM l")
def _(spark, d):
    return evaluate.dense_origins(hours(spark, d), 24, 24, 7)


@query("nearest_rank", f"WITH {HOURS}, l AS (SELECT series, list_sort(list(value)) AS v FROM s GROUP BY series) SELECT series, round(v[CAST(ceil(.8 * len(v)) AS BIGINT)], 6) AS q80, round(v[CAST(ceil(.05 * len(v)) AS BIGINT)], 6) AS q05 FROM l")
def _(spark, d):
    h = histories(hours(spark, d))
    return rounded(h.select("series", nearest_rank(F.col("h"), 0.8).alias("q80"), nearest_rank(F.col("h"), 0.05).alias("q05")))


@query(
    "event_adjusted",
    f"WITH {DAYS}, e AS (SELECT series, arg_min(value, idx) AS a, (arg_max(value, idx) - arg_min(value, idx)) / (count(*) - 1) AS b, arg_max(value, idx) AS p FROM s GROUP BY series), x AS (SELECT s.series, idx, value - a - b * idx AS x, idx % 10 < 3 AS on_ FROM s JOIN e USING (series)), u AS (SELECT series, avg(x) AS u FROM x WHERE NOT on_ GROUP BY series), w AS (SELECT x.series, x - u AS r, power(.6, idx % 10) AS dc, (idx % 10 + 1) / 3 AS rp FROM x JOIN u USING (series) WHERE on_), m AS (SELECT series, avg(r) AS l, sum(dc * r) / sum(dc * dc) AS d, sum(rp * r) / sum(rp * rp) AS g FROM w GROUP BY series), k AS (SELECT unnest(range(1, 6)) AS step) SELECT series, step, step IN (2, 3, 4) AS active, round(p, 6) AS point, round(CASE WHEN step IN (2, 3, 4) THEN p + l ELSE p END, 6) AS level, round(CASE WHEN step IN (2, 3, 4) THEN p + d * power(.6, step - 2) ELSE p END, 6) AS decayed, round(CASE WHEN step IN (2, 3, 4) THEN p + g * (step - 1) / 3 ELSE p END, 6) AS ramped FROM e JOIN m USING (series), k",
)
def _(spark, d):
    s = days(spark, d)
    steps = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))
    ahead = s.groupBy("series").agg(F.max_by("value", "idx").alias("point")).withColumn("step", steps).withColumn("active", F.col("step").between(2, 4))
    return rounded(context.event_adjusted(s.withColumn("active", F.col("idx") % 10 < 3), ahead))
