"""The query catalogue: each operator on series built from the test tables, with the same query in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import histories, indexed
from ..functions.parsing import parse_number, parse_time
from ..functions.stats import with_robust_scale
from ..operators import bitemporal, decisions, descriptive, evaluate, models, quality, tracking, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAYS = "d AS (SELECT event_type AS series, CAST(ts AS DATE) AS ts, sum(value) AS value FROM events GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS idx FROM d)"
HOURS = "d AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS idx FROM d)"
MONTHS = "d AS (SELECT 'orders' AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, sum(o_totalprice) / 1e6 AS value FROM orders GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS idx FROM d)"
ORDER_DAYS = "d AS (SELECT 'orders' AS series, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) / 1e6 AS value FROM orders GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS idx FROM d)"
VINTAGES = "v AS (SELECT event_type AS series, CAST(ts AS DATE) AS valid, ts AS known, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS revision, sum(value) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show, and counts as longs.

    Ties are those of the scaled binary value, as in DuckDB; round() with digits takes those of the shortest decimal form.
    """
    out, scale = [], F.lit(10.0**digits)
    for c, t in df.dtypes:
        x = F.col(c)
        out.append((F.round(x * scale) / scale + F.lit(0.0)).alias(c) if t == "double" else x.cast("long").alias(c) if t in ("int", "bigint", "smallint") else x)
    return df.select(*out)


def series(df: DataFrame, name, ts, value) -> DataFrame:
    return indexed(df.groupBy(name.alias("series"), ts.alias("ts")).agg(value.alias("value")))


def days(spark: SparkSession, d: str) -> DataFrame:
    return series(spark.read.parquet(f"{d}/events.parquet"), F.col("event_type"), F.to_date("ts"), F.sum("value"))


def hours(spark: SparkSession, d: str) -> DataFrame:
    return series(spark.read.parquet(f"{d}/events.parquet"), F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.sum("value"))


def months(spark: SparkSession, d: str) -> DataFrame:
    return series(spark.read.parquet(f"{d}/orders.parquet"), F.lit("orders"), F.trunc("o_orderdate", "month"), F.sum("o_totalprice") / 1e6)


def order_days(spark: SparkSession, d: str) -> DataFrame:
    return series(spark.read.parquet(f"{d}/orders.parquet"), F.lit("orders"), F.to_date("o_orderdate"), F.sum("o_totalprice") / 1e6)


def vintages(spark: SparkSession, d: str) -> DataFrame:
    """Running totals of a day as its successive estimates."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return e.select(F.col("event_type").alias("series"), F.to_date("ts").alias("valid"), F.col("ts").alias("known"), F.row_number().over(w).cast("long").alias("revision"), F.sum("value").over(w.rowsBetween(-(1 << 63), 0)).alias("value"))


@query("select_window", f"WITH {DAYS} SELECT series, ts, round(value, 6) AS value FROM s WHERE ts BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def _(spark, d):
    return rounded(windows.select_window(days(spark, d), "2024-01-05", "2024-01-20").select("series", "ts", "value"))


@query("resample_sum", f"WITH {DAYS} SELECT series, CAST(floor(idx / 7) AS BIGINT) AS idx, max(ts) AS ts, round(sum(value), 6) AS value FROM s GROUP BY series, floor(idx / 7) HAVING count(*) = 7")
def _(spark, d):
    return rounded(windows.resample(days(spark, d), 7, "sum"))


@query("resample_last", f"WITH {DAYS} SELECT series, CAST(floor(idx / 7) AS BIGINT) AS idx, max(ts) AS ts, round(arg_max(value, idx), 6) AS value FROM s GROUP BY series, floor(idx / 7) HAVING count(*) = 7")
def _(spark, d):
    return rounded(windows.resample(days(spark, d), 7, "last"))


@query("difference", f"WITH {DAYS} SELECT series, ts, round(x, 6) AS value FROM (SELECT *, value - lag(value, 7) OVER (PARTITION BY series ORDER BY idx) AS x FROM s) WHERE x IS NOT NULL")
def _(spark, d):
    return rounded(windows.difference(days(spark, d), 7).select("series", "ts", "value"))


@query("rolling_median_residual", f"WITH {HOURS} SELECT series, ts, round(value - median(value) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 6) AS residual FROM s")
def _(spark, d):
    return rounded(windows.rolling_median_residual(hours(spark, d), 24).select("series", "ts", "residual"))


@query("phase_profile", f"WITH {DAYS} SELECT series, idx % 7 AS phase, round(avg(value), 6) AS mean, round(median(value), 6) AS median, count(*) AS n FROM s GROUP BY ALL")
def _(spark, d):
    return rounded(windows.phase_profile(days(spark, d), 7))


SPLIT = "p AS (SELECT series, idx + 1 AS k, sum(value) OVER (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING) AS a, count(*) OVER (PARTITION BY series) AS n, sum(value) OVER (PARTITION BY series) AS t FROM s), q AS (SELECT *, a * a / k + (t - a) * (t - a) / (n - k) - t * t / n AS gain FROM p WHERE k >= 4 AND n - k >= 4), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY gain DESC, k) AS r FROM q) WHERE r = 1)"


@query("changepoint_split", f"WITH {MONTHS}, {SPLIT} SELECT series, k AS split, round(gain, 6) AS gain, round(a / k, 6) AS before, round((t - a) / (n - k), 6) AS after FROM b")
def _(spark, d):
    return rounded(windows.split_scan(months(spark, d)))


@query(
    "changepoint",
    f"""WITH {DAYS}, {SPLIT}, f AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS v FROM s), m AS (SELECT series, median(v) AS med, stddev_samp(v) AS sd FROM f WHERE v IS NOT NULL GROUP BY series),
    g AS (SELECT f.series, median(abs(v - med)) AS mad, any_value(sd) AS sd FROM f JOIN m USING (series) WHERE v IS NOT NULL GROUP BY f.series), h AS (SELECT series, count(*) AS n, var_pop(value) * count(*) AS sse FROM s GROUP BY series)
    SELECT series, k AS split, round(gain / sse, 6) AS relative_gain, h.n >= 12 AND gain > 2 * power(CASE WHEN mad > 1e-12 THEN 1.4826 * mad ELSE coalesce(sd, 0) END, 2) * sqrt(h.n) AS detected FROM b JOIN g USING (series) JOIN h USING (series)""",
)
def _(spark, d):
    return rounded(descriptive.changepoint(days(spark, d)).select("series", "split", "relative_gain", "detected"))


@query(
    "autocorrelation",
    f"""WITH {MONTHS}, f AS (SELECT series, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a FROM s GROUP BY series), r AS (SELECT s.series, idx, value - a - b * idx AS r FROM s JOIN f USING (series)),
    t AS (SELECT series, sum(r * r) AS d FROM r GROUP BY series) SELECT x.series, y.idx - x.idx AS lag, round(sum(x.r * y.r) / any_value(d), 6) AS acf FROM r x JOIN r y ON x.series = y.series AND y.idx - x.idx BETWEEN 1 AND 24 JOIN t ON t.series = x.series GROUP BY ALL""",
)
def _(spark, d):
    return rounded(windows.autocorrelation(months(spark, d), 24))


DECOMPOSED = """t AS (SELECT *, CASE WHEN count(*) OVER w = 12 THEN avg(value) OVER w END AS trend FROM s WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)), u AS (SELECT *, value - trend AS detrended FROM t),
    p AS (SELECT series, idx % 12 AS phase, avg(detrended) AS raw FROM u GROUP BY ALL), c AS (SELECT series, avg(raw) AS centre FROM p GROUP BY series), x AS (SELECT u.*, raw - centre AS seasonal, detrended - raw + centre AS residual FROM u JOIN p ON p.series = u.series AND p.phase = u.idx % 12 JOIN c ON c.series = u.series)"""


@query("decomposition", f"WITH {MONTHS}, {DECOMPOSED} SELECT series, ts, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(residual, 6) AS residual FROM x")
def _(spark, d):
    return rounded(windows.decompose(months(spark, d), 12).select("series", "ts", "trend", "seasonal", "residual"))


@query("seasonality", f"WITH {MONTHS}, {DECOMPOSED} SELECT series, round(greatest(0, 1 - var_pop(residual) / var_pop(detrended)), 6) AS strength FROM x WHERE trend IS NOT NULL GROUP BY series")
def _(spark, d):
    return rounded(descriptive.seasonality(months(spark, d), 12))


@query("runs", f"WITH {DAYS}, m AS (SELECT series, avg(value) AS m FROM s GROUP BY series), a AS (SELECT s.series, idx, idx - row_number() OVER (PARTITION BY s.series ORDER BY idx) AS g FROM s JOIN m USING (series) WHERE value > m) SELECT series, min(idx) AS first, max(idx) AS last, count(*) AS n FROM a GROUP BY series, g")
def _(spark, d):
    s = days(spark, d)
    mean = s.groupBy("series").agg(F.avg("value").alias("m"))
    return rounded(windows.runs(s.join(mean, "series").withColumn("on", F.col("value") > F.col("m")), "on"))


@query("infer_step", f"WITH {HOURS}, x AS (SELECT series, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS step FROM s), c AS (SELECT series, step, count(*) AS n, min(ts) AS seen FROM x WHERE step IS NOT NULL GROUP BY ALL) SELECT series, CAST(step AS BIGINT) AS step_seconds, n FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, seen) AS r FROM c) WHERE r = 1")
def _(spark, d):
    return rounded(quality.infer_step(hours(spark, d)))


@query("grid_gaps", f"WITH {HOURS}, x AS (SELECT series, ts, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS next_ts FROM s) SELECT series, ts, next_ts, CAST(floor((epoch(next_ts) - epoch(ts)) / 3600) AS BIGINT) - 1 AS missing FROM x WHERE epoch(next_ts) - epoch(ts) >= 7200")
def _(spark, d):
    return rounded(quality.gaps(hours(spark, d), 3600))


GRID = "x AS (SELECT *, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS nt, lead(value) OVER (PARTITION BY series ORDER BY ts) AS nv FROM s)"


@query("fill_linear", f"WITH {ORDER_DAYS}, {GRID}, y AS (SELECT *, unnest(range(0, coalesce(nt - ts, 1))) AS k FROM x) SELECT series, CAST(ts + CAST(k AS INTEGER) AS DATE) AS ts, round(CASE WHEN k = 0 THEN value ELSE value + (nv - value) * k / (nt - ts) END, 9) AS value, k > 0 AS filled FROM y")
def _(spark, d):
    return rounded(quality.fill_linear(order_days(spark, d)), 9)


@query("regrid_daily", f"WITH {ORDER_DAYS}, {GRID}, y AS (SELECT *, unnest(range(0, least(coalesce(nt - ts, 1) - 1, 10) + 1)) AS k FROM x) SELECT series, CAST(ts + CAST(k AS INTEGER) AS DATE) AS ts, round(value, 9) AS value, k > 0 AS filled FROM y")
def _(spark, d):
    return rounded(quality.regrid_daily(order_days(spark, d)), 9)


@query("regrid_month_start", f"WITH {ORDER_DAYS} SELECT series, CAST(date_trunc('month', ts) AS DATE) AS ts, round(arg_max(value, ts), 9) AS value, count(*) > 1 AS conflict FROM s GROUP BY series, date_trunc('month', ts)")
def _(spark, d):
    return rounded(quality.regrid_month_start(order_days(spark, d)), 9)


@query("collapse_duplicates", "SELECT event_type AS series, CAST(ts AS DATE) AS ts, round(arg_max(value, event_id), 6) AS value, count(*) AS n, count(DISTINCT value) AS n_values FROM events GROUP BY ALL")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("series"), F.to_date("ts").alias("ts"), "value", F.col("event_id").alias("file_row_no"))
    return rounded(quality.collapse_duplicates(e))


@query("snapshot_as_of", f"WITH {VINTAGES} SELECT series, valid, round(arg_max(value, revision), 6) AS value, max(known) AS known FROM v WHERE known <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY series, valid")
def _(spark, d):
    return rounded(bitemporal.snapshot(vintages(spark, d), "2024-01-15 12:00:00"))


@query("join_as_of", f"WITH {VINTAGES}, {DAYS}, k AS (SELECT series, valid, arg_max(value, revision) AS value FROM v WHERE known <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY series, valid) SELECT s.series, s.ts AS valid, round(k.value, 6) AS value FROM s LEFT JOIN k ON k.series = s.series AND k.valid = s.ts")
def _(spark, d):
    grid = days(spark, d).select("series", F.col("ts").alias("valid"))
    return rounded(bitemporal.join_as_of(grid, vintages(spark, d), "2024-01-15 12:00:00").select("series", "valid", "value"))


@query("as_of_folds", f"WITH {VINTAGES}, f(fold, cutoff) AS (VALUES (1, TIMESTAMP '2024-01-10 06:00:00'), (2, TIMESTAMP '2024-01-20 18:00:00')) SELECT CAST(fold AS BIGINT) AS fold, series, valid, round(arg_max(value, revision), 6) AS value FROM v JOIN f ON known <= cutoff AND valid <= cutoff GROUP BY fold, series, valid")
def _(spark, d):
    folds = spark.createDataFrame([(1, "2024-01-10 06:00:00"), (2, "2024-01-20 18:00:00")], "fold long, c string").select("fold", F.col("c").cast("timestamp_ntz").alias("cutoff"))
    return rounded(bitemporal.as_of_folds(vintages(spark, d), folds))


@query("ingest", f"WITH {VINTAGES}, st AS (SELECT * FROM v WHERE known < TIMESTAMP '2024-01-20'), bt AS (SELECT DISTINCT series, valid, known, value FROM v WHERE known >= TIMESTAMP '2024-01-10'), fresh AS (SELECT bt.* FROM bt ANTI JOIN st USING (series, valid, known, value)), l AS (SELECT series, valid, max(revision) AS last FROM st GROUP BY ALL) SELECT f.series, f.valid, f.known, coalesce(l.last, 0) + row_number() OVER (PARTITION BY f.series, f.valid ORDER BY f.known) AS revision FROM fresh f LEFT JOIN l ON l.series = f.series AND l.valid = f.valid")
def _(spark, d):
    v = vintages(spark, d)
    batch = v.where("known >= timestamp_ntz'2024-01-10'").withColumnRenamed("revision", "row_no")
    return rounded(bitemporal.ingest(v.where("known < timestamp_ntz'2024-01-20'"), batch).select("series", "valid", "known", "revision"))


@query("store_listing", f"WITH {VINTAGES} SELECT series, count(*) AS n, count(DISTINCT valid) AS n_valid, count(*) FILTER (revision > 1) AS n_revisions, min(known) AS first_known, max(known) AS last_known FROM v GROUP BY series")
def _(spark, d):
    return rounded(bitemporal.listing(vintages(spark, d)))


@query("active_events", f"WITH {HOURS} SELECT series, ts, (ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00' AND series = 'click') OR ts BETWEEN TIMESTAMP '2024-01-20 03:00:00' AND TIMESTAMP '2024-01-20 09:00:00' AS flag FROM s")
def _(spark, d):
    ev = spark.createDataFrame([("a", "click", "2024-01-05 00:00:00", "2024-01-06 12:00:00", "2024-01-01 00:00:00"), ("b", "*", "2024-01-20 03:00:00", "2024-01-20 09:00:00", "2024-01-01 00:00:00"), ("c", "*", "2024-01-10 00:00:00", "2024-01-11 00:00:00", "2024-02-01 00:00:00")], "event_id string, scope string, a string, b string, k string")
    ev = ev.select("event_id", "scope", F.col("a").cast("timestamp_ntz").alias("start"), F.col("b").cast("timestamp_ntz").alias("past"), F.col("k").cast("timestamp_ntz").alias("known_at"))
    return bitemporal.active_events(hours(spark, d).select("series", "ts"), ev).select("series", "ts", "flag")


ROBUST = "m AS (SELECT series, median(value) AS med, stddev_samp(value) AS sd FROM s GROUP BY series), r AS (SELECT s.series, any_value(med) AS med, median(abs(value - med)) AS mad, any_value(sd) AS sd FROM s JOIN m USING (series) GROUP BY s.series)"


@query("robust_scale", f"WITH {HOURS}, {ROBUST} SELECT series, round(med, 6) AS med, round(mad, 6) AS mad, round(CASE WHEN mad > 1e-12 THEN 1.4826 * mad ELSE coalesce(sd, 0) END, 6) AS scale FROM r")
def _(spark, d):
    return rounded(with_robust_scale(hours(spark, d)))


@query("anomaly_score", f"WITH {HOURS}, {ROBUST}, z AS (SELECT s.series, ts, (value - med) / (1.4826 * mad) AS z FROM s JOIN r USING (series)) SELECT series, ts, round(z, 4) AS z, abs(z) >= 3.5 AS anomalous FROM z")
def _(spark, d):
    return rounded(descriptive.anomaly_score(hours(spark, d)).select("series", "ts", "z", "anomalous"), 4)


@query("cross_correlation", f"WITH {DAYS}, f AS (SELECT series, idx, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS v FROM s), x AS (SELECT idx, v FROM f WHERE series = 'click' AND v IS NOT NULL), y AS (SELECT idx, v FROM f WHERE series = 'view' AND v IS NOT NULL) SELECT CAST(y.idx - x.idx AS BIGINT) AS lag, round(corr(x.v, y.v), 6) AS r, count(*) AS n FROM x JOIN y ON y.idx - x.idx BETWEEN -8 AND 8 GROUP BY ALL")
def _(spark, d):
    return rounded(descriptive.cross_correlation(days(spark, d), "click", "view").select("lag", "r", "n"))


@query("correlations", f"WITH {DAYS} SELECT a.series AS series_a, b.series AS series_b, round(corr(a.value, b.value), 6) AS r, count(*) AS n FROM s a JOIN s b ON a.ts = b.ts AND a.series < b.series GROUP BY ALL")
def _(spark, d):
    return rounded(descriptive.correlations(days(spark, d)))


@query(
    "event_study",
    f"""WITH {DAYS}, p AS (SELECT series, avg(value) AS before, median(value) AS c FROM s WHERE ts BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY series),
    m AS (SELECT s.series, median(abs(value - c)) AS mad FROM s JOIN p USING (series) WHERE ts BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY s.series),
    q AS (SELECT series, avg(value) AS after FROM s WHERE ts BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' GROUP BY series)
    SELECT series, 'launch' AS event_id, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS effect, round((after - before) / greatest(1.4826 * mad, 1e-12), 4) AS standardised FROM p JOIN m USING (series) JOIN q USING (series)
    UNION ALL SELECT DISTINCT series, 'too_late', NULL, NULL, NULL, NULL FROM s""",
)
def _(spark, d):
    s = days(spark, d)
    names = s.select("series").distinct()
    events = names.withColumn("event_id", F.lit("launch")).withColumn("at", F.lit("2024-01-15").cast("date")).unionByName(names.withColumn("event_id", F.lit("too_late")).withColumn("at", F.lit("2024-01-28").cast("date")))
    return rounded(descriptive.event_study(s, events))


@query("stationarity", f"WITH {DAYS}, x AS (SELECT series, lag(value) OVER (PARTITION BY series ORDER BY idx) AS x, value AS v FROM s), y AS (SELECT series, x, v - x AS y FROM x WHERE x IS NOT NULL), r AS (SELECT series, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, count(*) AS n FROM y GROUP BY series) SELECT series, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS t FROM r")
def _(spark, d):
    return rounded(descriptive.stationarity(days(spark, d)).select("series", "t"))


@query("profile", f"WITH {DAYS}, x AS (SELECT *, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS dv FROM s), y AS (SELECT *, CAST(dv * lag(dv) OVER (PARTITION BY series ORDER BY idx) < 0 AS INTEGER) AS turn FROM x) SELECT series, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high, round(regr_slope(value, idx), 6) AS slope, round(avg(turn), 6) AS reversal_rate, round(avg(CAST(value = 0 AS INTEGER)), 6) AS zero_share FROM y GROUP BY series")
def _(spark, d):
    return rounded(descriptive.profile(days(spark, d)))


@query("compare_windows", f"WITH {DAYS}, n AS (SELECT series, count(*) AS n FROM s GROUP BY series) SELECT series, round(avg(value) FILTER (idx >= n - 7), 6) AS mean_late, round(avg(value) FILTER (idx < n - 7), 6) AS mean_early, round(avg(value) FILTER (idx >= n - 7) - avg(value) FILTER (idx < n - 7), 6) AS change FROM s JOIN n USING (series) WHERE idx >= n - 14 GROUP BY series")
def _(spark, d):
    return rounded(descriptive.compare_windows(days(spark, d), 7).select("series", "mean_late", "mean_early", "change"))


@query("analogues")
def _(spark, d):
    return rounded(descriptive.analogues(hours(spark, d), 24))


@query("detect")
def _(spark, d):
    return rounded(descriptive.detect(hours(spark, d), 24))


H, SEASON = 3, 7
FOLDS = f"""{DAYS}, o AS (SELECT unnest(range(14, 28, 3)) AS origin), hist AS (SELECT series, origin, idx, value, row_number() OVER (PARTITION BY series, origin ORDER BY idx DESC) AS back FROM s JOIN o ON idx < origin),
  g AS (SELECT series, origin, max(idx) FILTER (back = 1) AS last_idx, max(value) FILTER (back = 1) AS last_value, max(value) FILTER (idx = 0) AS first_value, avg(value) FILTER (back <= 7) AS window_average, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, count(*) AS n FROM hist GROUP BY series, origin),
  k AS (SELECT unnest(range(1, 4)) AS lead),
  pred AS (SELECT g.series, g.origin, lead, 'last_value' AS model, last_value AS p FROM g, k UNION ALL SELECT g.series, g.origin, lead, 'drift', last_value + (last_value - first_value) / (n - 1) * lead FROM g, k UNION ALL SELECT g.series, g.origin, lead, 'linear_trend', a + b * (n - 1 + lead) FROM g, k UNION ALL SELECT g.series, g.origin, lead, 'window_average', window_average FROM g, k UNION ALL SELECT h.series, h.origin, lead, 'seasonal_naive', h.value FROM hist h, k WHERE h.idx = h.origin - 7 + (lead - 1) % 7),
  bt AS (SELECT p.series, p.origin, CASE WHEN p.origin = 26 THEN 'test' WHEN p.origin = 23 THEN 'calibrate' ELSE 'select' END AS role, model, lead, s.value AS actual, p.p AS predicted FROM pred p JOIN s ON s.series = p.series AND s.idx = p.origin + lead - 1),
  sc AS (SELECT series, origin, role, model, CASE WHEN sum(abs(actual)) > 1e-12 THEN sum(abs(actual - predicted)) / sum(abs(actual)) END AS wape FROM bt GROUP BY ALL)"""
LINEAR = ("last_value", "seasonal_naive", "drift", "linear_trend", "window_average")
CHOSEN = f"""{FOLDS}, mean AS (SELECT series, model, avg(wape) AS score FROM sc WHERE role = 'select' GROUP BY ALL), base AS (SELECT series, min(score) AS baseline_score, arg_min(model, score) AS baseline FROM mean WHERE model IN ('last_value', 'seasonal_naive') GROUP BY series),
  oth AS (SELECT series, min(score) AS rival_score, arg_min(model, score) AS rival FROM mean WHERE model NOT IN ('last_value', 'seasonal_naive') GROUP BY series),
  pw AS (SELECT sc.series, origin, max(wape) FILTER (model = baseline) AS wb, max(wape) FILTER (model = rival) AS wr FROM sc JOIN base USING (series) JOIN oth USING (series) WHERE role = 'select' GROUP BY ALL),
  w AS (SELECT series, avg(CAST(wr < wb AS INTEGER)) AS wins, median((wb - wr) / wb) AS gain FROM pw GROUP BY series),
  won AS (SELECT *, baseline_score > 0 AND rival_score <= baseline_score * 0.98 AND wins > 0.5 AND gain > 0 AS x FROM base JOIN oth USING (series) JOIN w USING (series)),
  ch AS (SELECT series, CASE WHEN x THEN rival ELSE baseline END AS model, CASE WHEN x THEN rival_score ELSE baseline_score END AS score, baseline, baseline_score FROM won)"""


@query("model_points", f"WITH {FOLDS} SELECT series, origin, lead, model, round(predicted, 6) AS predicted FROM bt")
def _(spark, d):
    return rounded(evaluate.backtest(days(spark, d), H, SEASON, LINEAR).select("series", "origin", "lead", "model", "predicted"))


@query("fold_scores", f"WITH {FOLDS} SELECT series, origin, role, model, round(wape, 6) AS wape FROM sc")
def _(spark, d):
    return rounded(evaluate.fold_scores(evaluate.backtest(days(spark, d), H, SEASON, LINEAR)))


@query("model_selection", f"WITH {CHOSEN} SELECT series, model, round(score, 6) AS score, baseline, round(baseline_score, 6) AS baseline_score FROM ch")
def _(spark, d):
    return rounded(evaluate.select_model(evaluate.fold_scores(evaluate.backtest(days(spark, d), H, SEASON, LINEAR))))


@query("residuals_by_lead", f"WITH {CHOSEN} SELECT series, lead, round(actual - predicted, 6) AS residual FROM bt JOIN ch USING (series, model) WHERE role <> 'test'")
def _(spark, d):
    bt = evaluate.backtest(days(spark, d), H, SEASON, LINEAR)
    return rounded(evaluate.residuals(bt, evaluate.select_model(evaluate.fold_scores(bt))))


@query("conformal_spreads", f"WITH {CHOSEN}, re AS (SELECT series, actual - predicted AS e FROM bt JOIN ch USING (series, model) WHERE role <> 'test'), l AS (SELECT series, list_sort(list(e)) AS e, count(*) AS n FROM re GROUP BY series) SELECT series, lead, round(e[greatest(1, CAST(floor((n + 1) * 0.1) AS BIGINT))], 6) AS s10, round(e[least(n, CAST(ceil((n + 1) * 0.9) AS BIGINT))], 6) AS s90 FROM l, k")
def _(spark, d):
    bt = evaluate.backtest(days(spark, d), H, SEASON, LINEAR)
    res = evaluate.residuals(bt, evaluate.select_model(evaluate.fold_scores(bt)))
    return rounded(evaluate.spreads(res).select("series", "lead", "s10", "s90"))


@query("theta", f"WITH RECURSIVE {DAYS}, al(alpha) AS (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)), r AS (SELECT series, alpha, idx, value AS level, 0.0::DOUBLE AS sse FROM s, al WHERE idx = 0 UNION ALL SELECT r.series, r.alpha, s.idx, r.alpha * s.value + (1 - r.alpha) * r.level, r.sse + power(s.value - r.level, 2) FROM r JOIN s ON s.series = r.series AND s.idx = r.idx + 1), e AS (SELECT series, arg_min(level, sse) AS level FROM (SELECT *, max(idx) OVER (PARTITION BY series) AS m FROM r) WHERE idx = m GROUP BY series), b AS (SELECT series, regr_slope(value, idx) AS b FROM s GROUP BY series) SELECT series, step, round(level + b / 2 * step, 6) AS point FROM e JOIN b USING (series), (SELECT unnest(range(1, 4)) AS step)")
def _(spark, d):
    h = histories(days(spark, d))
    return rounded(h.select("series", F.posexplode(models.theta(F.col("h"), H, SEASON)).alias("i", "point")).select("series", (F.col("i") + 1).alias("step"), "point"))


@query("ets")
def _(spark, d):
    h = histories(days(spark, d))
    return rounded(h.select("series", F.posexplode(models.ets(F.col("h"), H, SEASON)).alias("i", "point")).select("series", (F.col("i") + 1).alias("step"), "point"))


@query("forecast")
def _(spark, d):
    return rounded(evaluate.forecast(days(spark, d), H, SEASON))


@query(
    "ensemble",
    f"""WITH {FOLDS}, e AS (SELECT series, model, avg(wape) AS e FROM sc WHERE role = 'select' GROUP BY ALL), i AS (SELECT series, model, 1 / e / sum(1 / e) OVER (PARTITION BY series) AS w FROM e WHERE e > 0),
    l AS (SELECT series, origin, max(predicted) FILTER (model = 'last_value') AS last FROM bt GROUP BY ALL),
    a AS (SELECT bt.series, origin, lead, sum(coalesce(w, 0) * predicted) AS weighted, median(predicted) AS median, median(predicted) FILTER (predicted > last) AS up, median(predicted) FILTER (predicted < last) AS down, count(*) FILTER (predicted > last) AS u, count(*) FILTER (predicted < last) AS d, max(w) AS largest
      FROM bt LEFT JOIN i USING (series, model) JOIN l USING (series, origin) GROUP BY ALL)
    SELECT series, origin, lead, round(CASE WHEN largest <= 0.7 THEN weighted END, 6) AS weighted, round(median, 6) AS median, round(CASE WHEN u > (u + d) / 2 THEN up WHEN d > (u + d) / 2 THEN down ELSE median END, 6) AS vote FROM a""",
)
def _(spark, d):
    bt = evaluate.backtest(days(spark, d), H, SEASON, LINEAR)
    return rounded(evaluate.ensemble(bt, evaluate.fold_scores(bt)).select("series", "origin", "lead", "weighted", "median", "vote"))


UTILITY = [("hold", "calm", 0.7, 1.0), ("hold", "storm", 0.3, -5.0), ("scale", "calm", 0.7, -1.0), ("scale", "storm", 0.3, 4.0), ("wait", "calm", 0.7, 0.5), ("wait", "storm", 0.3, 0.5)]
TABLE = "u(action, scenario, p, utility) AS (VALUES " + ", ".join(f"('{a}', '{s}', {p}::DOUBLE, {u}::DOUBLE)" for a, s, p, u in UTILITY) + ")"


def utilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UTILITY, "action string, scenario string, p double, utility double")


@query("expected_utility", f"WITH {TABLE} SELECT action, round(sum(p * utility), 6) AS utility, round(sum(p), 6) AS p, row_number() OVER (ORDER BY sum(p * utility) DESC, action) AS rank FROM u GROUP BY action")
def _(spark, d):
    return rounded(decisions.expected_utility(utilities(spark)))


@query("maximin", f"WITH {TABLE} SELECT action, round(min(utility), 6) AS worst, round(avg(utility), 6) AS mean, row_number() OVER (ORDER BY min(utility) DESC, avg(utility) DESC, action) AS rank FROM u GROUP BY action")
def _(spark, d):
    return rounded(decisions.maximin(utilities(spark)))


@query("regret", f"WITH {TABLE} SELECT action, scenario, round(max(utility) OVER (PARTITION BY scenario) - utility, 6) AS regret FROM u")
def _(spark, d):
    return rounded(decisions.regret(utilities(spark).withColumn("feasible", F.lit(True))).select("action", "scenario", "regret"))


@query("threshold_risk")
def _(spark, d):
    s = days(spark, d)
    bt = evaluate.backtest(s, H, SEASON, LINEAR)
    res = evaluate.residuals(bt, evaluate.select_model(evaluate.fold_scores(bt)))
    level = s.groupBy().agg(F.avg("value")).first()[0]
    return rounded(decisions.risk_summary(decisions.threshold_risk(evaluate.forecast(s, H, SEASON, LINEAR), res, level)))


LEDGER = f"{FOLDS}, lg AS (SELECT model || '@' || origin AS forecast_id, series, model, origin, avg(abs(actual - predicted)) AS mae, avg(predicted - actual) AS bias, count(*) AS steps FROM bt GROUP BY series, model, origin), nv AS (SELECT series, avg(abs(x)) AS naive_error FROM (SELECT series, value - lag(value, 7) OVER (PARTITION BY series ORDER BY idx) AS x FROM s) GROUP BY series), ls AS (SELECT lg.*, mae / naive_error AS mase FROM lg JOIN nv USING (series))"


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every backtest forecast, scored as if it had been tracked."""
    s = days(spark, d)
    bt = evaluate.backtest(s, H, SEASON, LINEAR)
    f = bt.select(F.concat_ws("@", "model", "origin").alias("forecast_id"), "series", (F.col("origin") + F.col("lead") - 1).alias("ts"), F.col("predicted").alias("point"), (F.col("predicted") - 10).alias("low"), (F.col("predicted") + 10).alias("high"))
    naive = windows.difference(s, SEASON).groupBy("series").agg(F.avg(F.abs("value")).alias("naive_error"))
    out = tracking.score(f, s.select("series", F.col("idx").alias("ts"), F.col("value").alias("actual")), naive)
    return out.withColumn("model", F.substring_index("forecast_id", "@", 1)).withColumn("scored_at", F.substring_index("forecast_id", "@", -1).cast("long"))


@query("realised_scores", f"WITH {LEDGER} SELECT forecast_id, series, round(mae, 6) AS mae, round(bias, 6) AS bias, steps, round(mase, 6) AS mase FROM ls")
def _(spark, d):
    return rounded(ledger(spark, d).select("forecast_id", "series", "mae", "bias", "steps", "mase"))


@query("leaderboard", f"WITH {LEDGER} SELECT model, round(avg(mase), 6) AS mase, round(avg(mae), 6) AS mae, count(*) AS n, row_number() OVER (ORDER BY avg(mase), model) AS rank FROM ls GROUP BY model")
def _(spark, d):
    return rounded(tracking.leaderboard(ledger(spark, d)).select("model", "mase", "mae", "n", "rank"))


@query("drift_flags", f"WITH {LEDGER}, x AS (SELECT model, series, origin, mase, median(mase) OVER w AS usual, count(mase) OVER w AS n FROM ls WINDOW w AS (PARTITION BY model, series ORDER BY origin ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) SELECT model, series, origin AS scored_at, round(mase, 6) AS mase, CASE WHEN n = 4 AND usual > 0 AND mase / usual - 1 > 0.5 THEN 'degraded' WHEN n = 4 AND usual > 0 AND mase / usual - 1 > 0.25 THEN 'warning' ELSE 'stable' END AS drift FROM x")
def _(spark, d):
    # The ledger has five scores a model, so the window is one shorter than by default.
    return rounded(tracking.drift_flags(ledger(spark, d), window=4).select("model", "series", "scored_at", "mase", "drift"))


@query("adapted_alpha", f"WITH RECURSIVE {DAYS}, m AS (SELECT series, median(value) AS m FROM s GROUP BY series), c AS (SELECT s.series, idx, CAST(value <= m AS DOUBLE) AS c FROM s JOIN m USING (series)), r AS (SELECT series, -1::BIGINT AS idx, 0.2::DOUBLE AS alpha FROM m UNION ALL SELECT r.series, c.idx, greatest(0.01, least(0.5, r.alpha + 0.02 * (0.2 - (1 - c.c)))) FROM r JOIN c ON c.series = r.series AND c.idx = r.idx + 1) SELECT series, round(arg_max(alpha, idx), 6) AS alpha, count(*) - 1 AS n FROM r GROUP BY series")
def _(spark, d):
    s = days(spark, d)
    m = s.groupBy("series").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    return rounded(tracking.adapted_alpha(s.join(m, "series").select("series", F.col("idx").alias("at"), (F.col("value") <= F.col("m")).alias("covered"))))


@query("proposer_skill", "WITH e AS (SELECT event_type AS proposer, value - 50 AS lift, value > 50 AS hit FROM events) SELECT proposer, count(*) AS n, round(sum(lift) / (count(*) + 10), 6) AS lift, round((count(*) FILTER (hit) + 5) / (count(*) + 10), 6) AS hit_rate FROM e GROUP BY proposer")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("proposer"), (F.col("value") - 50).alias("lift"), (F.col("value") > 50).alias("hit"))
    return rounded(tracking.proposer_skill(e))


@query("effect_prior", f"WITH {DAYS}, e AS (SELECT series AS event_type, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS effect FROM s), f AS (SELECT event_type, effect, count(*) OVER w AS n, (sum(effect) OVER w - effect) / (count(*) OVER w - 1) AS others FROM e WHERE effect IS NOT NULL WINDOW w AS (PARTITION BY event_type)) SELECT event_type, max(n) AS n, round(sum(effect) / (max(n) + 3), 6) AS effect, max(n) >= 5 AND avg(abs(effect - others)) < avg(abs(effect)) AS usable FROM f GROUP BY event_type")
def _(spark, d):
    e = windows.difference(days(spark, d)).select(F.col("series").alias("event_type"), F.col("value").alias("effect"))
    return rounded(tracking.effect_prior(e))


CELLS = ["1,234.5", "12,34", "1.234,5", "1,234", "(5)", "$149", "12%", "N/A", "", "abc", "42", "-3.5"]


@query("parse_number", "SELECT * FROM (VALUES ('1,234.5', 1234.5::DOUBLE, 'normalised'), ('12,34', 12.34, 'normalised'), ('1.234,5', 1234.5, 'normalised'), ('1,234', 1234, 'assumptive'), ('(5)', -5, 'normalised'), ('$149', 149, 'normalised'), ('12%', 12, 'normalised'), ('N/A', NULL, 'missing'), ('', NULL, 'missing'), ('abc', NULL, 'error'), ('42', 42, 'clean'), ('-3.5', -3.5, 'clean')) t(cell, value, tier)")
def _(spark, d):
    c = spark.createDataFrame([(x,) for x in CELLS], "cell string").withColumn("n", parse_number(F.col("cell")))
    return c.select("cell", "n.value", "n.tier")


TIMES = ["2026-01-05", "2026-01-05T06:07:08Z", "1767225600", "1767225600000", "13/06/2026", "05/06/2026", "2026/05/18", "18 May 2026", "nonsense"]


@query("parse_time", "SELECT * FROM (VALUES ('2026-01-05', TIMESTAMP '2026-01-05 00:00:00'), ('2026-01-05T06:07:08Z', TIMESTAMP '2026-01-05 06:07:08'), ('1767225600', TIMESTAMP '2026-01-01 00:00:00'), ('1767225600000', TIMESTAMP '2026-01-01 00:00:00'), ('13/06/2026', TIMESTAMP '2026-06-13 00:00:00'), ('05/06/2026', NULL), ('2026/05/18', TIMESTAMP '2026-05-18 00:00:00'), ('18 May 2026', TIMESTAMP '2026-05-18 00:00:00'), ('nonsense', NULL)) t(cell, ts)")
def _(spark, d):
    return spark.createDataFrame([(x,) for x in TIMES], "cell string").withColumn("ts", parse_time(F.col("cell")))

from . import evidence_queries  # noqa: E402, F401

from . import ledger_queries  # noqa: E402, F401
from . import model_queries  # noqa: E402, F401
