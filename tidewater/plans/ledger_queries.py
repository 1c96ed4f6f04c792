"""Queries of the ledger, of published results and of context, with SQL written from their definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import parse_number
from ..operators import context, evaluate, ledger, results
from .catalogue import DAYS, FOLDS, HOURS, H, LEDGER, LINEAR, SEASON, VINTAGES, days, hours, query, rounded, vintages
from .catalogue import ledger as scored_ledger


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


NOW = "1997-06-01 00:00:00"
# A forecast is an order, its series the return flags of its lines, its steps their dates.
FORECASTS = "fc AS (SELECT l_orderkey AS forecast_id, l_returnflag AS series, l_shipdate AS ts, l_quantity AS q, l_linestatus AS st FROM lineitem), done AS (SELECT DISTINCT forecast_id, series FROM fc WHERE st = 'F')"


def forecasts(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("forecast_id"), F.col("l_returnflag").alias("series"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("q"), F.col("l_linestatus").alias("st"))
    return f, f.where("st = 'F'").select("forecast_id", "series")


@query("latest_registration", "SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, d):
    return ledger.latest(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate")


@query("newest_forecasts", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(spark, d):
    return ledger.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 50, "o_orderkey")


@query("first_seen", "SELECT l_partkey AS k, min(l_suppkey) AS v FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v"))
    return ledger.first_seen(rows, table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("k")), ["k"])


@query("naive_errors", f"WITH {HOURS}, x AS (SELECT *, abs(value - lag(value, 24) OVER (PARTITION BY series ORDER BY idx)) AS e FROM s) SELECT series, max(ts) AS cutoff, round(avg(e), 6) AS naive_error FROM x GROUP BY series")
def _(spark, d):
    return rounded(ledger.naive_errors(hours(spark, d), 24))


@query("due_forecasts", f"WITH {FORECASTS} SELECT forecast_id, series, max(ts) AS horizon_end, CASE WHEN max(ts) <= TIMESTAMP '{NOW}' THEN 'due' ELSE 'awaiting_horizon' END AS state FROM fc ANTI JOIN done USING (forecast_id, series) GROUP BY ALL")
def _(spark, d):
    return ledger.due(*forecasts(spark, d), ntz(NOW))


@query(
    "unscored_forecasts",
    f"WITH {FORECASTS}, h AS (SELECT DISTINCT series, ts, 1 AS h FROM fc WHERE q > 25), x AS (SELECT forecast_id, fc.series, min(fc.ts) AS first_ts, max(fc.ts) AS last_ts, count(*) AS required, count(h) AS supplied FROM fc ANTI JOIN done ON done.forecast_id = fc.forecast_id AND done.series = fc.series LEFT JOIN h ON h.series = fc.series AND h.ts = fc.ts GROUP BY forecast_id, fc.series) SELECT *, CASE WHEN supplied = 0 THEN 'no overlap' WHEN supplied < required THEN 'partial overlap' ELSE 'ready' END AS reason FROM x",
)
def _(spark, d):
    f, done = forecasts(spark, d)
    return ledger.unscored(f, done, f.where("q > 25"))


SCORES = "sc AS (SELECT o_orderpriority AS series, o_orderdate AS cutoff, o_orderkey AS forecast_id, o_totalprice / 1e5 AS mase, o_orderpriority AS model, o_orderdate AS known_at FROM orders)"


def scores(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("cutoff"), F.col("o_orderkey").alias("forecast_id"), (F.col("o_totalprice") / 1e5).alias("mase"), F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("known_at"))


@query(
    "compare_forecasts",
    f"WITH {SCORES}, x AS (SELECT series, cutoff, forecast_id AS a, mase AS mase_a, lead(forecast_id) OVER w AS b, lead(mase) OVER w AS mase_b FROM sc WINDOW w AS (PARTITION BY series, cutoff ORDER BY forecast_id)) SELECT series, cutoff, a, b, round(mase_a, 6) AS mase_a, round(mase_b, 6) AS mase_b, CASE WHEN mase_a < mase_b THEN 'a' ELSE 'b' END AS winner FROM x WHERE b IS NOT NULL",
)
def _(spark, d):
    return rounded(ledger.comparisons(scores(spark, d), ("series", "cutoff")))


@query("known_time", f"SELECT l_orderkey AS forecast_id, CASE WHEN count(*) FILTER (l_quantity > 5) = count(*) THEN max(l_shipdate) ELSE TIMESTAMP '{NOW}' END AS known_at FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("forecast_id"), F.when(F.col("l_quantity") > 5, F.col("l_shipdate")).alias("known_at"))
    return ledger.known_time(o, ["forecast_id"], ntz(NOW))


@query("performance_as_of", f"WITH {SCORES} SELECT model, count(*) AS n, round(avg(mase), 6) AS mase, round(arg_max(mase, {{'a': known_at, 'b': forecast_id}}), 6) AS last_mase FROM sc WHERE known_at <= TIMESTAMP '{NOW}' GROUP BY model")
def _(spark, d):
    return rounded(ledger.performance_as_of(scores(spark, d), ntz(NOW)))


@query(
    "ledger_status",
    f"WITH {FORECASTS}, u AS (SELECT max(ts) AS e FROM fc ANTI JOIN done USING (forecast_id, series) GROUP BY forecast_id, series), dc AS (SELECT CASE WHEN o_orderstatus <> 'O' THEN o_totalprice / 1e6 END AS regret FROM orders) SELECT (SELECT count(*) FROM u) AS open, (SELECT count(*) FROM u WHERE e <= TIMESTAMP '{NOW}') AS due, count(*) FILTER (regret IS NULL) AS unresolved, round(avg(regret), 6) AS mean_regret FROM dc",
)
def _(spark, d):
    f, done = forecasts(spark, d)
    decisions = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") / 1e6).alias("regret"))
    return rounded(ledger.status(f, done, decisions, ntz(NOW)))


@query(
    "proposal_outcomes",
    """WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS proposer, o_orderpriority AS event_type, o_totalprice AS t FROM orders), a AS (SELECT k, k % 2 = 0 AS admitted, k % 5 = 0 AS published FROM p WHERE k % 3 <> 0), o AS (SELECT k, (t - 1e5) / 1e6 AS lift, CASE WHEN k % 8 = 0 THEN t > 1e5 END AS hit FROM p WHERE k % 4 = 0)
    SELECT proposer, event_type, count(*) AS proposals, count(*) FILTER (admitted) AS admitted, count(*) FILTER (published) AS published, count(lift) AS resolved, round(sum(lift) / nullif(count(lift), 0), 6) AS mean_lift, round(coalesce(sum(lift), 0) / (count(lift) + 10), 6) AS shrunk_lift, round((count(*) FILTER (hit) + 5) / (count(hit) + 10), 6) AS shrunk_hit_rate FROM p LEFT JOIN a USING (k) LEFT JOIN o USING (k) GROUP BY proposer, event_type""",
)
def _(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("forecast_id"), F.col("o_orderpriority").alias("series"), F.col("o_custkey").alias("proposal_key"), F.col("o_orderstatus").alias("proposer"), F.col("o_orderpriority").alias("event_type"), F.col("o_totalprice").alias("t"))
    key, k = ["forecast_id", "series", "proposal_key"], F.col("forecast_id")
    a = p.where(k % 3 != 0).select(*key, (k % 2 == 0).alias("admitted"), (k % 5 == 0).alias("published"))
    o = p.where(k % 4 == 0).select(*key, ((F.col("t") - 1e5) / 1e6).alias("lift"), F.when(k % 8 == 0, F.col("t") > 1e5).alias("hit"))
    return rounded(ledger.proposal_outcomes(p.drop("t"), a, o))


@query(
    "realised_lift",
    f"WITH {FOLDS}, x AS (SELECT a.model || '@' || a.origin AS forecast_id, a.series, a.actual, a.predicted AS p, b.predicted AS c FROM bt a JOIN bt b ON b.series = a.series AND b.origin = a.origin AND b.lead = a.lead AND b.model = 'last_value'), y AS (SELECT forecast_id, series, sum(abs(actual - c)) / sum(abs(actual)) AS base_wape, sum(abs(actual - p)) / sum(abs(actual)) AS published_wape FROM x GROUP BY ALL) SELECT forecast_id, series, round(base_wape, 6) AS base_wape, round(published_wape, 6) AS published_wape, round(base_wape - published_wape, 6) AS lift FROM y",
)
def _(spark, d):
    bt = evaluate.backtest(days(spark, d), H, SEASON, LINEAR)
    base = F.max(F.when(F.col("model") == "last_value", F.col("predicted"))).over(Window.partitionBy("series", "origin", "lead"))
    rows = bt.withColumn("counterfactual", base).select(F.concat_ws("@", "model", "origin").alias("forecast_id"), "series", "actual", F.col("predicted").alias("published"), "counterfactual")
    return rounded(ledger.realised_lift(rows))


@query(
    "effect_estimates",
    f"""WITH {DAYS}, m AS (SELECT series, avg(value) AS p FROM s GROUP BY series), x AS (SELECT e.e || '/' || s.series AS effect_id, s.series, idx, value - p AS r, idx BETWEEN e.a AND e.b AS on_ FROM s JOIN m USING (series), (VALUES ('early', 3, 7), ('late', 6, 9), ('apart', 15, 18)) e(e, a, b) WHERE idx < 20),
    b AS (SELECT effect_id, avg(r) FILTER (NOT on_) AS bias, var_samp(r) FILTER (NOT on_) AS v0, count(*) FILTER (NOT on_) AS n0 FROM x GROUP BY effect_id), y AS (SELECT x.effect_id, x.series, r - bias AS r, row_number() OVER (PARTITION BY x.effect_id ORDER BY idx) - 1 AS i, bias, v0, n0 FROM x JOIN b USING (effect_id) WHERE on_),
    c AS (SELECT *, median(r) OVER (PARTITION BY effect_id) AS c FROM y), n AS (SELECT *, 1.4826 * median(abs(r - c)) OVER (PARTITION BY effect_id) AS noise FROM c),
    g AS (SELECT effect_id, series, count(*) AS n, avg(r) AS estimate, any_value(bias) AS bias, sqrt(var_samp(r) / count(*) + any_value(v0) / any_value(n0)) AS se, min(i) FILTER (abs(r) >= greatest(noise, abs(c) * .1, 1e-12)) AS onset, max(i) FILTER (abs(r) >= greatest(noise, abs(c) * .1, 1e-12)) AS lst, regr_slope(r, i) AS slope, arg_min(r, i) AS r0, arg_max(r, i) AS r1, any_value(greatest(abs(c), noise, 1e-12)) AS lvl FROM n GROUP BY ALL)
    SELECT effect_id, series, n, round(estimate, 6) AS estimate, round(bias, 6) AS bias, round(se, 6) AS se, round(estimate - {ledger.Z80} * se, 6) AS low, round(estimate + {ledger.Z80} * se, 6) AS high, onset, lst - onset + 1 AS duration, CASE WHEN abs(slope) * n >= .5 * lvl THEN 'trend_change' WHEN abs(r1) < .5 * abs(r0) THEN 'temporary_pulse' ELSE 'level_shift' END AS shape, effect_id NOT LIKE 'apart%' AS confounded FROM g""",
)
def _(spark, d):
    s = days(spark, d).where("idx < 20")
    m = days(spark, d).groupBy("series").agg(F.avg("value").alias("primary"))
    e = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (("early", 3, 7), ("late", 6, 9), ("apart", 15, 18))]))
    x = s.join(m, "series").withColumn("e", e)
    on = F.col("idx").between(F.col("e.a"), F.col("e.b"))
    return rounded(ledger.effect_estimates(x.select(F.concat_ws("/", "e.n", "series").alias("effect_id"), "series", F.col("idx").alias("step"), F.col("value").alias("actual"), "primary", (F.col("primary") + F.when(on, 10.0).otherwise(0.0)).alias("scenario"))))


@query(
    "pooled_priors",
    f"""WITH {DAYS}, e AS (SELECT 'phase' || (idx % 3) AS event_type, series, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS x FROM s), f AS (SELECT *, row_number() OVER () AS id, abs(x) / 10 AS se FROM e WHERE x IS NOT NULL),
    l AS (SELECT a.id, a.event_type, a.x, avg(b.x) AS others, avg(b.x) FILTER (b.series = a.series) AS own, count(*) FILTER (b.series = a.series) AS k FROM f a JOIN f b ON a.event_type = b.event_type AND a.id <> b.id GROUP BY ALL), r AS (SELECT event_type, abs(x - coalesce(k / (k + 3) * own + (1 - k / (k + 3)) * others, others)) AS err, abs(x) AS z FROM l),
    q AS (SELECT event_type, count(*) AS episodes, avg(err) AS mae, avg(z) AS zero, list_sort(list(err))[least(count(*), CAST(ceil(.8 * (count(*) + 1)) AS BIGINT))] AS ch FROM r GROUP BY event_type), t AS (SELECT event_type, avg(x) AS tm, greatest(0, {ledger.Z80} * sqrt(var_samp(x) + avg(se * se))) AS ph FROM f GROUP BY event_type),
    o AS (SELECT event_type, series, avg(x) AS lm, count(*) AS local_n FROM f GROUP BY ALL), w AS (SELECT o.event_type, series, local_n, episodes, local_n / (local_n + 3) * lm + (1 - local_n / (local_n + 3)) * tm AS effect, greatest(ph, ch) AS half, episodes >= 5 AND mae < zero AS validated FROM o JOIN t USING (event_type) JOIN q USING (event_type))
    SELECT event_type, series, local_n, episodes, round(effect, 6) AS effect, round(effect - half, 6) AS low, round(effect + half, 6) AS high, validated FROM w""",
)
def _(spark, d):
    x = F.col("value") - F.lag("value").over(Window.partitionBy("series").orderBy("idx"))
    e = days(spark, d).select(F.concat(F.lit("phase"), (F.col("idx") % 3).cast("string")).alias("event_type"), "series", x.alias("estimate")).where("estimate is not null")
    return rounded(ledger.pooled_priors(e.withColumn("se", F.abs("estimate") / 10)))


@query(
    "shadow_assessment",
    f"""WITH {FOLDS}, x AS (SELECT a.model AS candidate, a.wape AS c, b.wape AS b FROM sc a JOIN sc b ON b.series = a.series AND b.origin = a.origin AND b.model = 'last_value' WHERE a.model <> 'last_value'), ga AS (SELECT candidate, 'last_value' AS baseline, count(*) AS n, avg((b - c) / b) AS improvement, avg(CAST(c < b AS INTEGER)) AS win_rate FROM x GROUP BY candidate)
    SELECT candidate, baseline, n, round(improvement, 6) AS improvement, round(win_rate, 6) AS win_rate, concat_ws(',', CASE WHEN n < 20 THEN 'insufficient_paired_outcomes' END, CASE WHEN improvement < .05 THEN 'mean_improvement_below_gate' END, CASE WHEN win_rate < .6 THEN 'win_rate_below_gate' END) AS reasons, n >= 20 AND improvement >= .05 AND win_rate >= .6 AS promote FROM ga""",
)
def _(spark, d):
    sc = evaluate.fold_scores(evaluate.backtest(days(spark, d), H, SEASON, LINEAR))
    base = sc.where("model = 'last_value'").select("series", "origin", F.col("wape").alias("baseline_error"))
    rows = sc.where("model <> 'last_value'").join(base, ["series", "origin"]).select(F.col("model").alias("candidate"), F.lit("last_value").alias("baseline"), F.col("wape").alias("candidate_error"), "baseline_error")
    return rounded(ledger.shadow(rows, least=20))


CDF = "0.5 * (1 + sign(z) * (1 - (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-z * z / 2)))"


@query(
    "pooled_gain",
    f"WITH e AS (SELECT p_brand AS key, (p_retailprice - 1400) / 1000 AS gain, 0.05 + p_size / 100 AS se FROM part), a AS (SELECT key, sum(gain / (se * se)) / sum(1 / (se * se)) AS gain, sqrt(1 / sum(1 / (se * se))) AS se FROM e GROUP BY key), b AS (SELECT *, gain / se AS z, 1 / (1 + 0.3275911 * abs(gain / se) / sqrt(2)) AS t FROM a) SELECT key, round(gain, 6) AS gain, round(se, 6) AS se, round(greatest(0, 2 * {CDF} - 1), 6) AS weight FROM b",
)
def _(spark, d):
    p = table(spark, d, "part")
    return rounded(ledger.pooled_gain(p.select(F.col("p_brand").alias("key"), ((F.col("p_retailprice") - 1400) / 1000).alias("gain"), (0.05 + F.col("p_size") / 100).alias("se"))))


@query(
    "registry_match",
    """WITH q AS (SELECT c_custkey AS query_id, c_mktsegment AS model, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END AS state FROM customer), m AS (SELECT DISTINCT model FROM q), n AS (SELECT DISTINCT nation FROM q WHERE CAST(nation AS INTEGER) < 5),
    r AS (SELECT model || '/any' AS entry_id, model, '*' AS nation, '*' AS state FROM m UNION ALL SELECT model || '/' || nation, model, nation, '*' FROM m, n UNION ALL SELECT model || '/owes', model, '*', 'owes' FROM m),
    x AS (SELECT query_id, entry_id, CAST(r.nation <> '*' AS INTEGER) + CAST(r.state <> '*' AS INTEGER) AS sp FROM q JOIN r ON r.model = q.model AND r.nation IN ('*', q.nation) AND r.state IN ('*', q.state)), y AS (SELECT *, max(sp) OVER (PARTITION BY query_id) AS top FROM x) SELECT query_id, min(entry_id) AS entry_id, CAST(max(sp) AS BIGINT) AS specificity, count(*) > 1 AS ambiguous FROM y WHERE sp = top GROUP BY query_id""",
)
def _(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("model"), F.col("c_nationkey").cast("string").alias("nation"), F.when(F.col("c_acctbal") < 0, "owes").otherwise("has").alias("state"))
    m, n = q.select("model").distinct(), q.where(F.col("nation").cast("int") < 5).select("nation").distinct()
    any_ = m.select(F.concat("model", F.lit("/any")).alias("entry_id"), "model", F.lit("*").alias("nation"), F.lit("*").alias("state"))
    own = m.crossJoin(n).select(F.concat("model", F.lit("/"), "nation").alias("entry_id"), "model", "nation", F.lit("*").alias("state"))
    owes = m.select(F.concat("model", F.lit("/owes")).alias("entry_id"), "model", F.lit("*").alias("nation"), F.lit("owes").alias("state"))
    return ledger.registry_match(q, any_.unionByName(own).unionByName(owes), ["nation", "state"])


@query("access_summary", "SELECT user_id AS entity, event_type AS variable, count(*) AS reads, max(ts) AS known_at FROM events GROUP BY ALL")
def _(spark, d):
    return ledger.access_summary(table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("variable"), F.col("ts").alias("known_at")))


@query("dataset_identity", f"WITH {VINTAGES} SELECT series, count(*) AS rows, max(known) AS known_at, sha256(series || '|' || count(*) || '|' || epoch_us(max(known)) || '|' || max(revision)) AS identity FROM v GROUP BY series")
def _(spark, d):
    return ledger.dataset_identity(vintages(spark, d))


@query("provenance", "WITH x AS (SELECT DISTINCT l_suppkey AS series, CASE WHEN o_orderstatus = 'F' THEN 'recorded' ELSE 'assumed' END AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT series, CASE WHEN count(*) > 1 THEN 'partially_assumed' ELSE min(k) END AS known_time FROM x GROUP BY series")
def _(spark, d):
    store = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_orderkey").alias("ingest_id"))
    ingests = table(spark, d, "orders").select(F.col("o_orderkey").alias("ingest_id"), F.when(F.col("o_orderstatus") == "F", "recorded").otherwise("assumed").alias("known_time"))
    return ledger.provenance(store, ingests)


@query(
    "paired_runs",
    """WITH a AS (SELECT o_orderkey AS t, o_totalprice > 1e5 AS s0, o_orderkey % 50 = 0 AS v0 FROM orders), b AS (SELECT l_orderkey AS t, sum(l_quantity) > 100 AS s1, false AS v1 FROM lineitem GROUP BY l_orderkey), j AS (SELECT *, s0 IS NOT NULL AND s1 IS NOT NULL AND NOT coalesce(v0 OR v1, false) AS ok FROM a FULL JOIN b USING (t))
    SELECT count(*) AS tasks, count(*) FILTER (s0 IS NULL OR s1 IS NULL) AS unmatched, count(*) FILTER (ok) AS graded, round(avg(CAST(s0 AS INTEGER)) FILTER (ok), 6) AS baseline, round(avg(CAST(s1 AS INTEGER)) FILTER (ok), 6) AS treatment, count(*) FILTER (ok AND s1 AND NOT s0) AS won, count(*) FILTER (ok AND s0 AND NOT s1) AS lost, round(avg(CAST(s1 AS INTEGER)) FILTER (ok) - avg(CAST(s0 AS INTEGER)) FILTER (ok), 6) AS uplift FROM j""",
)
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_totalprice") > 1e5).alias("success"), (F.col("o_orderkey") % 50 == 0).alias("voided"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg((F.sum("l_quantity") > 100).alias("success")).withColumn("voided", F.lit(False))
    return rounded(ledger.paired_runs(a, b))


@query("pass_rates", "WITH x AS (SELECT l_orderkey AS task_id, CASE WHEN l_quantity <= 45 THEN l_quantity > 10 END AS s FROM lineitem) SELECT task_id, count(s) AS measured, round(avg(CAST(s AS INTEGER)), 6) AS rate, bool_and(s) AS pass_all FROM x GROUP BY task_id")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("attempt"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity") > 10).alias("success"))
    return rounded(ledger.pass_rates(x))


@query("route_prior", "WITH x AS (SELECT event_type AS model, value / 50 AS mase, 1 / (1 + (user_id % 17) / 4) AS w FROM events), a AS (SELECT model, count(*) AS n, sum(w * mase) / sum(w) AS score FROM x GROUP BY model HAVING count(*) >= 10) SELECT model, n, round(score, 6) AS score, row_number() OVER (ORDER BY score, model) AS rank FROM a")
def _(spark, d):
    e = table(spark, d, "events")
    p = e.select(F.col("event_type").alias("model"), F.col("user_id").alias("series"), (F.col("value") / 50).alias("mase"))
    return rounded(ledger.route_prior(p, e.select(F.col("user_id").alias("series"), ((F.col("user_id") % 17) / 4).alias("distance")).distinct()))


# --- published results

RESULTS = "fr AS (SELECT o_custkey AS series, o_orderkey AS step, o_totalprice AS point, o_totalprice > 2e5 AS crosses, o_orderpriority AS tier FROM orders), nt AS (SELECT series, arg_min(point, step) AS a, arg_max(point, step) AS b, bool_or(crosses) AS x, count(*) AS n, min(tier) AS tier FROM fr GROUP BY series), rs AS (SELECT series, tier, round(CASE WHEN x THEN 10 ELSE 0 END + CASE WHEN n > 1 THEN abs(b - a) / greatest(abs(a), 1e-12) ELSE 0 END, 6) AS notability FROM nt)"


def published(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("point"), (F.col("o_totalprice") > 2e5).alias("crosses"), F.col("o_orderpriority").alias("tier"))
    return results.notability(r).join(r.groupBy("series").agg(F.min("tier").alias("tier")), "series")


@query("notability", f"WITH {RESULTS} SELECT series, notability, tier FROM rs")
def _(spark, d):
    return rounded(published(spark, d))


@query("artifact_query", f"WITH {RESULTS}, m AS (SELECT * FROM rs WHERE tier = '1-URGENT') SELECT series, notability, (SELECT count(*) FROM m) AS matched FROM m ORDER BY notability DESC, series LIMIT 25")
def _(spark, d):
    rows, matched = results.select_results(published(spark, d), where={"tier": "1-URGENT"}, order_by="notability", limit=25, fields=["notability"])
    return rounded(rows.withColumn("matched", F.lit(matched)))


@query(
    "triage",
    f"WITH {RESULTS}, k AS (SELECT *, row_number() OVER (ORDER BY notability DESC, series) AS place FROM rs) SELECT series, notability, tier, place, 1 AS n FROM k WHERE place <= 3 UNION ALL SELECT NULL, NULL, tier, NULL, count(*) FROM k WHERE place > 3 GROUP BY tier",
)
def _(spark, d):
    return rounded(results.triage(published(spark, d)))


@query("tier_counts", f"WITH {RESULTS} SELECT tier, count(*) AS n FROM rs GROUP BY tier")
def _(spark, d):
    return results.tier_counts(published(spark, d))


@query("head_tail", f"WITH {HOURS}, n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM s) SELECT series, idx, round(value, 6) AS value FROM n WHERE idx < 3 OR idx >= n - 2")
def _(spark, d):
    return rounded(results.head_tail(hours(spark, d)).select("series", "idx", "value"))


@query("id_mismatches", "SELECT DISTINCT p_partkey AS k, 'a' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) UNION ALL SELECT DISTINCT l_partkey, 'b' FROM lineitem WHERE l_quantity > 40 AND l_partkey NOT IN (SELECT p_partkey FROM part)")
def _(spark, d):
    return results.id_mismatches(table(spark, d, "part").select(F.col("p_partkey").alias("k")), table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k")), "k")


FLAGS = f"{HOURS}, nv AS (SELECT series, idx FROM s WHERE value > 200 AND idx % 11 <> 0), st AS (SELECT series, idx, NOT (idx % 13 = 0 OR idx % 17 = 0) AS stray FROM nv)"


def flagged(spark, d):
    s = hours(spark, d)
    return results.flag_sets(s.where("value > 200"), s.where("idx % 11 = 0"), s.where("idx % 13 = 0"), s.where("idx % 17 = 0"))


@query("flag_sets", f"WITH {FLAGS} SELECT series, idx, stray FROM st")
def _(spark, d):
    return flagged(spark, d)


@query("false_alarms", f"WITH {FLAGS}, i AS (SELECT series, idx - row_number() OVER (PARTITION BY series ORDER BY idx) AS i FROM st WHERE stray) SELECT series, count(DISTINCT i) AS alarms FROM i GROUP BY series")
def _(spark, d):
    return results.false_alarms(flagged(spark, d).where("stray"))


@query("supportable_horizons", f"WITH {HOURS}, n AS (SELECT series, count(*) AS n FROM s GROUP BY series), h AS (SELECT series, n, unnest(range(1, n // 4 + 1)) AS h FROM n) SELECT n.series, n.n, max(h) FILTER (n.n >= greatest(48, 2 * h, 8) + 2 * h) AS horizon FROM n LEFT JOIN h USING (series) GROUP BY n.series, n.n")
def _(spark, d):
    return rounded(results.supportable_horizons(hours(spark, d), 24))


@query(
    "best_effort",
    f"WITH {DAYS}, x AS (SELECT *, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS d FROM s), a AS (SELECT series, arg_max(value, idx) AS p, stddev_samp(d) AS sd FROM x GROUP BY series), k AS (SELECT unnest(range(1, 6)) AS step) SELECT series, step, round(p, 6) AS point, round(p - 1.2815515655446008 * sd * sqrt(step), 6) AS q10, round(p, 6) AS q50, round(p + 1.2815515655446008 * sd * sqrt(step), 6) AS q90, 'best_effort' AS tier FROM a, k",
)
def _(spark, d):
    return rounded(results.best_effort(days(spark, d), 5).select("series", "step", "point", "q10", "q50", "q90", "tier"))


@query(
    "horizon_split",
    f"WITH {DAYS}, a AS (SELECT series, arg_max(value, idx) AS p, row_number() OVER (ORDER BY series) - 1 AS h FROM s GROUP BY series), k AS (SELECT unnest(range(1, 6)) AS step) SELECT series, step, round(CASE WHEN step <= h THEN p + 1 ELSE p END, 6) AS point, CASE WHEN step <= h THEN 'supported' ELSE 'best_effort' END AS tier FROM a, k",
)
def _(spark, d):
    f = results.best_effort(days(spark, d), 5).select("series", "step", "point", "tier")
    names = f.select("series").distinct()
    prefix = names.select("series", (F.row_number().over(Window.orderBy("series")) - 1).alias("horizon"))
    return rounded(results.horizon_split(f.withColumn("point", F.col("point") + 1).withColumn("tier", F.lit("supported")), f, prefix))


@query("lightweight_selection", f"WITH {FOLDS}, x AS (SELECT * FROM sc WHERE origin = 26) SELECT series, arg_min(model, {{'a': wape, 'b': model}}) FILTER (model IN ('last_value', 'seasonal_naive')) AS model, round(min(wape) FILTER (model IN ('last_value', 'seasonal_naive')), 6) AS score, true AS guarded FROM x GROUP BY series")
def _(spark, d):
    sc = evaluate.fold_scores(evaluate.backtest(days(spark, d), H, SEASON, LINEAR))
    return rounded(results.lightweight(sc.where("origin = 26")))


@query(
    "support_grading",
    """WITH x AS (SELECT o_custkey AS series, count(*) - 1 AS folds, avg(CAST(o_totalprice > 1e5 AS INTEGER)) AS coverage, 7 AS horizon, 7 + CAST(o_custkey % 3 AS INTEGER) AS requested FROM orders GROUP BY o_custkey), y AS (SELECT *, CASE WHEN folds = 0 THEN 'inconclusive' WHEN folds >= 4 AND coverage >= .7 THEN 'supported' ELSE 'conditionally_supported' END AS status FROM x)
    SELECT series, status, CASE WHEN status = 'inconclusive' THEN 'best_effort' ELSE status END AS tier, horizon < requested AS part FROM y""",
)
def _(spark, d):
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("series")).agg((F.count("*") - 1).alias("folds"), F.avg((F.col("o_totalprice") > 1e5).cast("int")).alias("coverage"))
    x = x.withColumn("horizon", F.lit(7)).withColumn("requested", (7 + F.col("series") % 3).cast("int"))
    return results.graded(x).select("series", "status", "tier", (F.col("horizon") < F.col("requested")).alias("part"))


@query(
    "decide_state",
    """WITH c AS (SELECT user_id AS series, event_type AS label, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT series, label, n / sum(n) OVER (PARTITION BY series) AS p, CAST(sum(n) OVER (PARTITION BY series) AS BIGINT) AS folds, 'view' AS ps FROM c), b AS (SELECT series, first(label ORDER BY p DESC, label = ps DESC, label DESC) AS mode, max(p) AS p, any_value(folds) AS folds FROM p GROUP BY series)
    SELECT series, CASE WHEN folds >= 8 AND p >= .3 THEN mode ELSE 'view' END AS state, mode, round(p, 6) AS p, folds >= 8 AND p >= .3 AS automatic FROM b""",
)
def _(spark, d):
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("series"), F.col("event_type").alias("label")).count()
    w = Window.partitionBy("series")
    p = c.select("series", "label", (F.col("count") / F.sum("count").over(w)).alias("p"), F.sum("count").over(w).alias("folds"), F.lit("view").alias("point_state"), F.lit(0.6).alias("accuracy"), F.lit(0.1).alias("skill"))
    return rounded(results.decide_state(p, least=0.3))


@query(
    "adjudicated_evidence",
    """WITH v AS (SELECT user_id AS series, event_type AS value, CASE WHEN value > 50 THEN 'supported' ELSE 'weak' END AS support, 'view' AS canonical FROM events), a AS (SELECT series, value, sum(CASE support WHEN 'supported' THEN 1.0 ELSE .25 END) AS weight, count(*) AS sources, value = any_value(canonical) AS own FROM v GROUP BY series, value),
    r AS (SELECT *, row_number() OVER w AS rank, lead(weight) OVER w AS nxt FROM a WINDOW w AS (PARTITION BY series ORDER BY weight DESC, sources DESC, own DESC, value)) SELECT series, value, round(weight, 6) AS weight, sources, rank, CASE WHEN rank = 1 THEN round(weight - coalesce(nxt, 0), 6) END AS margin FROM r""",
)
def _(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_type").alias("value"), F.lit("event").alias("source"), F.when(F.col("value") > 50, "supported").otherwise("weak").alias("support"), F.lit("view").alias("canonical"))
    return rounded(results.adjudicate(v))


# --- context

CLAIMS = f"""{DAYS}, lv AS (SELECT series, avg(value) AS m FROM s GROUP BY series), cl AS (SELECT series || '/floor' AS event_id, series AS scope, TIMESTAMP '2024-01-10' AS a, TIMESTAMP '2024-01-20' AS b, 'min' AS kind, m AS value FROM lv UNION ALL SELECT series || '/cap', series, TIMESTAMP '2024-01-31', TIMESTAMP '2024-02-02', 'max', m FROM lv UNION ALL SELECT 'all/low', '*', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-10', 'min', -1e9 FROM (SELECT 1))"""


def claims(spark, d):
    m = days(spark, d).groupBy("series").agg(F.avg("value").alias("value"))
    row = lambda name, a, b, kind: m.select(F.concat("series", F.lit(f"/{name}")).alias("event_id"), F.array("series").alias("scope"), ntz(a).alias("start"), ntz(b).alias("end"), F.lit(kind).alias("kind"), "value")
    wide = m.groupBy().agg(F.lit(-1e9).alias("value")).select(F.lit("all/low").alias("event_id"), F.array(F.lit("*")).alias("scope"), ntz("2024-01-01").alias("start"), ntz("2024-02-10").alias("end"), F.lit("min").alias("kind"), "value")
    events = row("floor", "2024-01-10", "2024-01-20", "min").unionByName(row("cap", "2024-01-31", "2024-02-02", "max")).unionByName(row("pin", "2024-01-31", "2024-02-02", "pin")).unionByName(wide)
    return events.withColumn("known_at", ntz("2024-01-05")).withColumn("status", F.lit("confirmed")).withColumn("source", F.lit("desk"))


def daily(spark, d):
    return days(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "checked_claims",
    f"WITH {CLAIMS}, x AS (SELECT s.series, event_id, count(*) FILTER (CASE WHEN kind = 'min' THEN s.value < cl.value ELSE s.value > cl.value END AND ts BETWEEN a AND b) AS violations, min(CAST(ts AS TIMESTAMP)) FILTER (CASE WHEN kind = 'min' THEN s.value < cl.value ELSE s.value > cl.value END AND ts BETWEEN a AND b) AS first_violation, any_value(kind) AS kind, any_value(cl.value) AS value FROM s JOIN cl ON cl.scope IN (s.series, '*') GROUP BY ALL) SELECT series, event_id, kind, round(value, 6) AS value, violations, first_violation, violations = 0 AS usable FROM x",
)
def _(spark, d):
    return rounded(context.checked_claims(claims(spark, d), daily(spark, d)))


PATHS = "pt AS (SELECT series, step, CAST(DATE '2024-01-30' + CAST(step AS INTEGER) AS TIMESTAMP) AS ts, p AS point, p - 20 AS q10, p AS q50, p + 20 AS q90 FROM (SELECT series, arg_max(value, idx) AS p FROM s GROUP BY series), (SELECT unnest(range(1, 6)) AS step))"


def paths(spark, d):
    last = daily(spark, d).groupBy("series").agg(F.max_by("value", "idx").alias("point"))
    p = last.select("series", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("step"), "point")
    return p.select("series", "step", F.date_add(F.lit("2024-01-30").cast("date"), F.col("step").cast("int")).cast("timestamp_ntz").alias("ts"), "point", (F.col("point") - 20).alias("q10"), F.col("point").alias("q50"), (F.col("point") + 20).alias("q90"))


@query("applied_claims", f"WITH {CLAIMS}, {PATHS}, x AS (SELECT pt.*, m, step <= 3 AS c FROM pt JOIN lv USING (series)) SELECT series, step, round(CASE WHEN c THEN least(point, m) ELSE point END, 6) AS point, round(CASE WHEN c THEN least(q10, m) ELSE q10 END, 6) AS q10, round(CASE WHEN c THEN least(q90, m) ELSE q90 END, 6) AS q90, c AND q90 > m AS clamped FROM x")
def _(spark, d):
    usable = context.parsed_claims(claims(spark, d)).where("problem is null and kind = 'max'").unionByName(context.parsed_claims(claims(spark, d)).where("event_id = 'all/low'"))
    return rounded(context.apply_claims(paths(spark, d), usable).select("series", "step", "point", "q10", "q90", "clamped"))


@query("crossed_quantiles", f"WITH {DAYS}, x AS (SELECT series, ts, value - 100 * (idx % 3) AS q10, value AS q50, value + 50 - 40 * (idx % 4) AS q90 FROM s) SELECT series, ts, 'q10' AS lower, 'q50' AS upper FROM x WHERE q10 > q50 UNION ALL SELECT series, ts, 'q50', 'q90' FROM x WHERE q50 > q90")
def _(spark, d):
    v, i = F.col("value"), F.col("idx")
    return context.crossed(days(spark, d).select("series", "ts", (v - 100 * (i % 3)).alias("q10"), v.alias("q50"), (v + 50 - 40 * (i % 4)).alias("q90")))


@query(
    "event_eligibility",
    "WITH e AS (SELECT user_id AS event_id, event_type AS scope, CASE WHEN event_id % 7 = 0 THEN 'cancelled' ELSE 'confirmed' END AS status, CASE WHEN event_id % 5 <> 0 THEN 'desk' END AS source, ts AS a, event_id AS id FROM events), n AS (SELECT DISTINCT event_type AS series FROM events), x AS (SELECT series, id AS event_id, CASE WHEN scope <> series THEN 'scope does not include this series' WHEN status = 'cancelled' THEN 'cancelled event cannot affect the primary forecast' WHEN source IS NULL THEN 'no verifiable source; not admissible for backtesting' END AS reason FROM e, n) SELECT series, event_id, reason IS NULL AS eligible, reason FROM x",
)
def _(spark, d):
    e = table(spark, d, "events")
    ev = e.select("event_id", F.array("event_type").alias("scope"), F.col("ts").alias("start"), F.col("ts").alias("end"), F.col("ts").alias("known_at"), F.when(F.col("event_id") % 7 == 0, "cancelled").otherwise("confirmed").alias("status"), F.when(F.col("event_id") % 5 != 0, "desk").alias("source"))
    return context.eligibility(ev, e.select(F.col("event_type").alias("series")))


@query(
    "event_flags",
    f"WITH {HOURS} SELECT series, ts, (series = 'view' AND ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00') OR ts BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-20 23:00:00' AS active FROM s",
)
def _(spark, d):
    rows = [("a", ["view"], "2024-01-10 06:00:00", "2024-01-12 18:00:00", "2024-01-01 00:00:00"), ("b", ["*"], "2024-01-20 00:00:00", "2024-01-20 23:00:00", "2024-01-15 00:00:00"), ("c", ["*"], "2024-01-22 00:00:00", "2024-01-23 00:00:00", "2024-01-22 00:00:00")]
    ev = spark.createDataFrame(rows, "event_id string, scope array<string>, start string, end string, known_at string")
    ev = ev.select("event_id", "scope", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end", "known_at")])
    return context.event_flags(hours(spark, d), ev, ntz("2024-01-21 00:00:00")).select("series", "ts", "active")


@query(
    "covariate_coverage",
    f"WITH {DAYS}, v AS (SELECT event_type AS series, CAST(ts AS DATE) AS ts, ts AS known, value AS t, CASE WHEN event_id % 3 > 0 THEN value END AS u FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'), l AS (SELECT series, ts, arg_max(u, known) FILTER (u IS NOT NULL) AS dummy, arg_max({{'u': u}}, known) AS x FROM v GROUP BY ALL), j AS (SELECT s.series, s.ts, l.x IS NULL AS t_none, l.x.u IS NULL AS u_none FROM s LEFT JOIN l USING (series, ts)) SELECT series, 't' AS name, count(*) AS needed, count(*) FILTER (t_none) AS missing, min(ts) FILTER (t_none) AS first_missing FROM j GROUP BY series UNION ALL SELECT series, 'u', count(*), count(*) FILTER (u_none), min(ts) FILTER (u_none) FROM j GROUP BY series",
)
def _(spark, d):
    v = table(spark, d, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("valid_at"), F.col("ts").alias("known_at"), F.col("value").alias("t"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("u"))
    return context.covariate_coverage(days(spark, d), v, ["t", "u"], ntz("2024-01-20 12:00:00"))


@query(
    "covariate_problems",
    "WITH x AS (SELECT event_type AS series, CAST(ts AS DATE) AS valid_at, date_trunc('minute', ts) AS known_at, CASE WHEN event_id % 11 > 0 THEN value END AS t, CAST(event_id % 4 AS DOUBLE) AS f FROM events), y AS (SELECT *, count(*) OVER (PARTITION BY series, valid_at, known_at) AS n FROM x), z AS (SELECT series, valid_at, known_at, CASE WHEN n > 1 THEN 'duplicate vintage' WHEN t IS NULL THEN 't: missing' WHEN f NOT IN (0, 1) THEN 'f: not 0 or 1' END AS problem FROM y) SELECT * FROM z WHERE problem IS NOT NULL",
)
def _(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("valid_at"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("known_at"), F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("t"), (F.col("event_id") % 4).cast("double").alias("f"))
    return context.covariate_problems(x, context.covariate_specs("t:continuous:future_known, f:binary:future_known"))


@query(
    "enrichment_gate",
    f"""WITH {FOLDS}, x AS (SELECT a.series || '/' || a.model AS key, (b.wape - a.wape) / b.wape AS g FROM sc a JOIN sc b ON b.series = a.series AND b.origin = a.origin AND b.model = 'last_value' WHERE a.model <> 'last_value'), y AS (SELECT key, count(g) AS folds, avg(g) AS gain, avg(CAST(g > 0 AS INTEGER)) AS wins, (sum(g) - max(g)) / (count(g) - 1) AS wb, stddev_samp(g) AS sd FROM x GROUP BY key),
    z AS (SELECT *, 1 - power(sd / sqrt(folds) / gain, 2) AS f FROM y) SELECT key, folds, round(gain, 6) AS gain, round(wins, 6) AS wins, round(wb, 6) AS without_best, folds >= 4 AND gain >= .02 AND wins > .5 AND wb > 0 AS admitted, round(CASE WHEN gain <= 0 THEN 0 WHEN f < .1 THEN 0 ELSE least(f, 1) END, 6) AS factor FROM z""",
)
def _(spark, d):
    sc = evaluate.fold_scores(evaluate.backtest(days(spark, d), H, SEASON, LINEAR))
    base = sc.where("model = 'last_value'").select("series", "origin", F.col("wape").alias("base"))
    x = sc.where("model <> 'last_value'").join(base, ["series", "origin"]).select(F.concat_ws("/", "series", "model").alias("key"), F.col("origin").alias("fold"), "base", F.col("wape").alias("enriched"))
    gains = x.select("key", ((F.col("base") - F.col("enriched")) / F.col("base")).alias("gain"))
    return rounded(context.admitted(x).join(context.shrinkage(gains).select("key", "factor"), "key"))


@query("ladder_ranking", f"WITH {FOLDS}, m AS (SELECT series, model, avg(wape) AS score, length(model) % 3 AS e, length(model) AS p FROM sc GROUP BY series, model) SELECT series, model AS candidate, round(score, 6) AS score, row_number() OVER (PARTITION BY series ORDER BY score, e, p) AS rank FROM m")
def _(spark, d):
    sc = evaluate.fold_scores(evaluate.backtest(days(spark, d), H, SEASON, LINEAR))
    m = sc.groupBy("series", F.col("model").alias("candidate")).agg(F.avg("wape").alias("score")).withColumn("enrichments", F.length("candidate") % 3).withColumn("position", F.length("candidate"))
    return rounded(context.ladder(m).select("series", "candidate", "score", "rank"))


@query(
    "override_conflicts",
    "WITH e AS (SELECT event_id, event_type AS series, ts AS a, ts + INTERVAL 20 MINUTE AS b, CAST(event_id % 3 AS DOUBLE) AS v FROM events) SELECT x.series, x.event_id AS a, y.event_id AS b FROM e x JOIN e y ON x.series = y.series AND x.event_id < y.event_id AND x.a <= y.b AND y.a <= x.b AND x.v <> y.v",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("series"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 20 minutes")).alias("end"), (F.col("event_id") % 3).cast("double").alias("value"))
    return context.windows_conflict(e)


@query(
    "applied_overrides",
    f"WITH {DAYS}, l AS (SELECT series, arg_max(value, idx) AS p FROM s GROUP BY series), k AS (SELECT unnest(range(1, 6)) AS step), x AS (SELECT series, step, p + 10 * step AS point, CASE WHEN step >= 3 THEN -10 * (step - 3) ELSE 0 END AS m FROM l, k) SELECT series, step, round(CASE WHEN step = 5 THEN 77 ELSE point + m END, 6) AS point, round(CASE WHEN step = 5 THEN 77 ELSE point + m END - 5, 6) AS q10 FROM x",
)
def _(spark, d):
    p = paths(spark, d).withColumn("point", F.col("point") + 10 * F.col("step")).withColumn("q10", F.col("point") - 5).select("series", "step", "ts", "point", "q10")
    names = p.select("series").distinct()
    ev = names.select("series", F.lit("a").alias("event_id"), ntz("2024-02-02").alias("start"), ntz("2024-02-09").alias("end"), F.lit("trend_ceases").alias("effect"), F.lit(None).cast("double").alias("value"))
    ev = ev.unionByName(names.select("series", F.lit("b").alias("event_id"), ntz("2024-02-04").alias("start"), ntz("2024-02-04").alias("end"), F.lit("override").alias("effect"), F.lit(77.0).alias("value")))
    return rounded(context.apply_overrides(p, ev).select("series", "step", "point", "q10"))


@query(
    "conditional_effects",
    f"WITH {DAYS}, e AS (SELECT series, arg_min(value, idx) AS a, (arg_max(value, idx) - arg_min(value, idx)) / (count(*) - 1) AS b FROM s GROUP BY series), x AS (SELECT s.series, value - a - b * idx AS x, idx % 7 IN (2, 3) AS on_ FROM s JOIN e USING (series)), y AS (SELECT series, count(*) FILTER (on_) AS n_active, count(*) FILTER (NOT on_) AS n_inactive, avg(x) FILTER (on_) - avg(x) FILTER (NOT on_) AS effect, sqrt(var_samp(x) FILTER (on_) / count(*) FILTER (on_) + var_samp(x) FILTER (NOT on_) / count(*) FILTER (NOT on_)) AS se FROM x GROUP BY series) SELECT series, n_active, n_inactive, round(effect, 6) AS effect, round(se, 6) AS se, round(effect - {context.Z80} * se, 6) AS low, round(effect + {context.Z80} * se, 6) AS high FROM y",
)
def _(spark, d):
    return rounded(context.conditional_effects(days(spark, d).withColumn("active", (F.col("idx") % 7).isin(2, 3))))


@query(
    "sensitivity_paths",
    f"WITH {DAYS}, fd AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS v FROM s), c AS (SELECT series, 1.4826 * mad(v) AS sc FROM fd WHERE v IS NOT NULL GROUP BY series), l AS (SELECT series, arg_max(value, idx) AS p FROM s GROUP BY series), k AS (SELECT unnest(range(1, 6)) AS step) SELECT l.series, step, round(p - sc * CASE WHEN step >= 3 THEN step - 2 ELSE 0 END, 6) AS what_if FROM l JOIN c USING (series), k",
)
def _(spark, d):
    return rounded(context.sensitivity(days(spark, d), paths(spark, d).withColumn("active", F.col("step").between(3, 4)), -1, True).select("series", "step", "what_if"))


@query(
    "event_shapes",
    f"WITH {DAYS}, o AS (SELECT series, idx, idx - row_number() OVER (PARTITION BY series ORDER BY idx) AS i FROM s WHERE idx % 7 < 4), w AS (SELECT series, idx, row_number() OVER (PARTITION BY series, i ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY series, i) AS n FROM o) SELECT series, idx, 1.0::DOUBLE AS level, round(power(0.6, k), 6) AS decay, round((k + 1) / n, 6) AS ramp FROM w",
)
def _(spark, d):
    return rounded(context.event_shapes(days(spark, d).withColumn("active", F.col("idx") % 7 < 4)).select("series", "idx", "level", "decay", "ramp"))


@query("usual_level", f"WITH {HOURS}, n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM s) SELECT series, round(median(value), 6) AS level FROM n WHERE idx >= n - 24 GROUP BY series")
def _(spark, d):
    return rounded(context.usual_level(hours(spark, d)))


@query(
    "parse_table_numbers",
    """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CASE l_linenumber % 6 WHEN 0 THEN '$' || CAST(l_quantity AS BIGINT) WHEN 1 THEN '(' || CAST(l_quantity AS BIGINT) || ')' WHEN 2 THEN CAST(l_quantity AS BIGINT) || '%' WHEN 3 THEN CASE WHEN l_quantity > 25 THEN 'n.a.' ELSE '#REF!' END WHEN 4 THEN '1,' || CAST(100 + l_quantity AS BIGINT) || '.5' ELSE ' ' || CAST(l_quantity AS BIGINT) || ' ' END AS cell FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 1 THEN -q WHEN 3 THEN NULL WHEN 4 THEN 1100 + q + .5 ELSE q END::DOUBLE AS value, CASE l_linenumber % 6 WHEN 3 THEN 'missing' WHEN 5 THEN 'clean' ELSE 'normalised' END AS tier FROM c""",
)
def _(spark, d):
    q, k = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber") % 6
    cell = F.when(k == 0, F.concat(F.lit("$"), q)).when(k == 1, F.concat(F.lit("("), q, F.lit(")"))).when(k == 2, F.concat(q, F.lit("%"))).when(k == 3, F.when(F.col("l_quantity") > 25, "n.a.").otherwise("#REF!")).when(k == 4, F.concat(F.lit("1,"), (F.col("l_quantity") + 100).cast("long").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit(" "), q, F.lit(" ")))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), parse_number(cell).alias("n")).select("l_orderkey", "l_linenumber", "n.value", "n.tier")
