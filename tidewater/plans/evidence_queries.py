"""Queries of the evidence operators, with SQL written from their definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descriptive, evaluate, evidence, windows
from .catalogue import DAYS, FOLDS, HOURS, H, LINEAR, SEASON, days, hours, order_days, ORDER_DAYS, query, rounded

SCALE_A = "greatest(1.4826 * mad({0}), 1e-12)"
SCALE_B = "(CASE WHEN mad({0}) > 1e-12 THEN 1.4826 * mad({0}) ELSE coalesce(stddev_samp({0}), 0) END)"
DIFFS = "fd AS (SELECT series, idx, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS v FROM s)"


@query(
    "anomaly_score_seasonal",
    f"""WITH {HOURS}, a AS (SELECT *, value - median(value) OVER (PARTITION BY series, idx % 24) AS x FROM s), c AS (SELECT series, {SCALE_A.format('x')} AS scale, count(*) AS n FROM a GROUP BY series)
    SELECT a.series, ts, round(x / scale, 4) AS z, abs(round(x / scale, 4)) >= 3.5 AS anomalous FROM a JOIN c USING (series) WHERE n >= 48""",
)
def _(spark, d):
    return rounded(descriptive.anomaly_score(hours(spark, d), 24).select("series", "ts", "z", "anomalous"), 4)


def _segmentation(sensitivity: float) -> str:
    parts = [f"WITH {HOURS}, {DIFFS}", f"lim AS (SELECT h.series, {sensitivity} * 2 * power(any_value(sc), 2) * sqrt(count(*)) AS penalty, var_pop(value) * count(*) AS sse FROM s h JOIN (SELECT series, {SCALE_A.format('v')} AS sc FROM fd WHERE v IS NOT NULL GROUP BY series) USING (series) GROUP BY h.series HAVING count(*) >= 12)", "r0 AS (SELECT series, idx, value, 0 AS seg FROM s)"]
    for i in range(3):
        parts += [
            f"x{i} AS (SELECT *, value - avg(value) OVER (PARTITION BY series, seg) AS x, count(*) OVER (PARTITION BY series, seg) AS m, idx - seg + 1 AS k FROM r{i})",
            f"p{i} AS (SELECT *, sum(x) OVER (PARTITION BY series, seg ORDER BY idx ROWS UNBOUNDED PRECEDING) AS a FROM x{i})",
            f"g{i} AS (SELECT series, seg, idx + 1 AS split, a * a * (1 / k + 1 / (m - k)) AS gain FROM p{i} WHERE k >= 4 AND m - k >= 4)",
            f"b{i} AS (SELECT g.series, arg_max(seg, gain) AS seg, arg_max(split, gain) AS split, max(gain) AS gain, any_value(sse) AS sse FROM g{i} g JOIN lim USING (series) GROUP BY g.series HAVING max(gain) > any_value(penalty))",
            f"r{i + 1} AS (SELECT r.series, idx, value, CASE WHEN b.seg = r.seg AND idx >= split THEN split ELSE r.seg END AS seg FROM r{i} r LEFT JOIN b{i} b USING (series))",
        ]
    parts.append("f AS (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(3)) + ")")
    parts.append("cp AS (SELECT f.series, split, any_value(gain) / (any_value(sse) + 1e-12) AS relative_gain, avg(value) FILTER (idx < split) AS before_mean, avg(value) FILTER (idx >= split) AS after_mean FROM f JOIN s ON s.series = f.series AND idx BETWEEN split - 12 AND split + 11 GROUP BY f.series, split)")
    return ", ".join(parts)


@query("changepoints", _segmentation(0.2) + " SELECT cp.series, split, ts, round(before_mean, 6) AS before_mean, round(after_mean, 6) AS after_mean, round(after_mean - before_mean, 6) AS shift, round(relative_gain, 6) AS relative_gain FROM cp JOIN s ON s.series = cp.series AND s.idx = split")
def _(spark, d):
    return rounded(descriptive.changepoints(hours(spark, d), 0.2))


@query(
    "regimes",
    _segmentation(0.2)
    + f""", w AS (SELECT cp.series, split, idx - split AS off, value FROM cp JOIN s ON s.series = cp.series AND idx >= split - 24), sc AS (SELECT series, split, {SCALE_A.format('value')} AS scale, avg(value) AS pre FROM w WHERE off < 0 GROUP BY ALL),
    q AS (SELECT w.series, w.split, count(*) FILTER (off >= 0) AS post, abs(avg(value) FILTER (off BETWEEN 0 AND 11) - avg(value) FILTER (off BETWEEN -12 AND -1)) / any_value(scale) AS standardised, abs(avg(value) FILTER (off >= 4) - any_value(pre)) / any_value(scale) AS tail FROM w JOIN sc ON sc.series = w.series AND sc.split = w.split GROUP BY w.series, w.split)
    SELECT series, split, post, round(standardised, 6) AS standardised, round(tail, 6) AS tail, CASE WHEN post < 5 THEN 'undetermined' WHEN tail < greatest(1, standardised / 2) THEN 'transient_anomaly' ELSE 'regime_shift' END AS regime FROM q""",
)
def _(spark, d):
    s = hours(spark, d)
    return rounded(descriptive.regimes(s, descriptive.changepoints(s, 0.2)))


@query(
    "ranked_changes",
    _segmentation(0.2) + ", q AS (SELECT *, max(relative_gain) OVER (PARTITION BY series) AS top FROM cp) SELECT series, split, round(relative_gain, 6) AS share, row_number() OVER (PARTITION BY series ORDER BY relative_gain DESC, split) AS rank, top > 0 AND relative_gain >= top / 2 AS dominant FROM q",
)
def _(spark, d):
    from ..operators import results

    return rounded(results.ranked_changes(descriptive.changepoints(hours(spark, d), 0.2)))


@query(
    "local_slope",
    f"""WITH {HOURS}, n AS (SELECT series, count(*) AS n FROM s GROUP BY series), h AS (SELECT series, n, least(greatest(greatest(9, least(n // 20, 101)), 49), greatest(3, n - 1)) AS w FROM n), k AS (SELECT series, n, (w + CASE WHEN w % 2 = 0 THEN 1 ELSE 0 END) // 2 AS half FROM h),
    fd AS (SELECT series, idx, lead(value) OVER (PARTITION BY series ORDER BY idx) - value AS v FROM s), sl AS (SELECT a.series, a.idx, median(b.v) AS m FROM fd a JOIN k USING (series) JOIN fd b ON b.series = a.series AND b.idx BETWEEN a.idx - half AND a.idx + half WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.series, a.idx),
    c AS (SELECT series, median(m) AS med, {SCALE_A.format('m')} AS scale, max(idx) AS last FROM sl GROUP BY series), z AS (SELECT sl.series, idx, (m - med) / scale AS score, last FROM sl JOIN c USING (series))
    SELECT series, idx, round(score, 5) AS score FROM z UNION ALL SELECT series, idx + 1, round(score, 5) FROM z WHERE idx = last""",
)
def _(spark, d):
    return rounded(evidence.local_slope_scores(hours(spark, d), 24).select("series", "idx", "score"), 5)


@query(
    "rolling_median_score",
    f"WITH {HOURS}, r AS (SELECT series, idx, value - median(value) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS r FROM s), c AS (SELECT series, {SCALE_A.format('r')} AS scale FROM r GROUP BY series) SELECT series, idx, round(r / scale, 5) AS score FROM r JOIN c USING (series)",
)
def _(spark, d):
    return rounded(descriptive.rolling_median_scores(hours(spark, d), 24).select("series", "idx", "score"), 5)


@query(
    "causal_residuals",
    f"""WITH {HOURS}, x AS (SELECT *, lag(value) OVER w AS l1, lag(value, 8) OVER w AS l8, lag(value, 24) OVER w AS ls, first_value(value) OVER w AS f FROM s WINDOW w AS (PARTITION BY series ORDER BY idx))
    SELECT series, ts, round(value - CASE WHEN idx >= 48 THEN ls ELSE l1 + (l1 - CASE WHEN idx >= 8 THEN l8 ELSE f END) / greatest(1, least(8, idx) - 1) END, 6) AS residual FROM x WHERE idx >= 24""",
)
def _(spark, d):
    return rounded(evidence.causal_residuals(hours(spark, d), 24).select("series", "ts", "residual"))


@query(
    "detect_season",
    f"""WITH {HOURS}, f AS (SELECT series, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, count(*) AS n FROM s GROUP BY series), r AS (SELECT s.series, idx, value - a - b * idx AS r FROM s JOIN f USING (series)), t AS (SELECT series, sum(r * r) AS d FROM r GROUP BY series),
    c AS (SELECT x.series, y.idx - x.idx AS lag, sum(x.r * y.r) / any_value(d) AS acf, any_value(n) AS n FROM r x JOIN f ON f.series = x.series JOIN t ON t.series = x.series JOIN r y ON x.series = y.series AND y.idx - x.idx BETWEEN 1 AND least(n // 2, 366) GROUP BY ALL),
    p AS (SELECT *, lag(acf) OVER w AS before, lead(acf) OVER w AS after FROM c WINDOW w AS (PARTITION BY series ORDER BY lag)), q AS (SELECT series, min(lag) AS lag, arg_min(acf, lag) AS acf FROM p WHERE lag >= 2 AND after IS NOT NULL AND acf >= greatest(0.3, 2 / sqrt(n)) AND acf > before AND acf >= after GROUP BY series)
    SELECT f.series, coalesce(lag, 24) AS period, round(coalesce(acf, 0), 6) AS strength, CASE WHEN lag IS NULL THEN 'frequency_default' ELSE 'autocorrelation' END AS source FROM f LEFT JOIN q USING (series)""",
)
def _(spark, d):
    return rounded(evidence.detect_season(hours(spark, d), 24))




@query(
    "detect_season_planted",
    f"""WITH d AS (SELECT event_type AS series, CAST(ts AS DATE) AS ts, sum(value) AS value FROM events GROUP BY ALL), s AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS idx, 1000 * sin(2 * pi() * (row_number() OVER (PARTITION BY series ORDER BY ts) - 1) / 6) + value / 1000 AS value FROM d),
    f AS (SELECT series, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, count(*) AS n FROM s GROUP BY series), r AS (SELECT s.series, idx, value - a - b * idx AS r FROM s JOIN f USING (series)), t AS (SELECT series, sum(r * r) AS d FROM r GROUP BY series),
    c AS (SELECT x.series, y.idx - x.idx AS lag, sum(x.r * y.r) / any_value(d) AS acf FROM r x JOIN t ON t.series = x.series JOIN r y ON x.series = y.series AND y.idx - x.idx BETWEEN 1 AND 15 GROUP BY ALL) SELECT series, lag AS period, round(acf, 6) AS strength, 'autocorrelation' AS source FROM c WHERE lag = 6""",
)
def _(spark, d):
    s = days(spark, d)
    return rounded(evidence.detect_season(s.withColumn("value", 1000 * F.sin(2 * F.pi() * F.col("idx") / 6) + F.col("value") / 1000), 7))


@query(
    "kpss",
    f"""WITH {HOURS}, e AS (SELECT series, idx, value - avg(value) OVER (PARTITION BY series) AS e, count(*) OVER (PARTITION BY series) AS n FROM s), c AS (SELECT *, sum(e) OVER (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING) AS c FROM e),
    b AS (SELECT series, any_value(n) AS n, greatest(1, CAST(floor(4 * power(any_value(n) / 100, 0.25)) AS BIGINT)) AS bw, sum(e * e) / any_value(n) AS g, sum(c * c) AS cc FROM c GROUP BY series),
    l AS (SELECT b.series, unnest(range(1, bw + 1)) AS k FROM b), v AS (SELECT l.series, k, sum(x.e * y.e) AS s FROM l JOIN e x ON x.series = l.series JOIN e y ON y.series = x.series AND y.idx = x.idx - k GROUP BY ALL),
    r AS (SELECT b.series, any_value(g) + sum(2 * (1 - k / (bw + 1)) * s / n) AS lr FROM b JOIN v USING (series) GROUP BY b.series) SELECT b.series, n, bw AS bandwidth, round(cc / (n * n * greatest(lr, 1e-12)), 6) AS statistic, CASE WHEN cc / (n * n * greatest(lr, 1e-12)) > 0.463 THEN 'nonstationary' ELSE 'stationarity_not_rejected' END AS conclusion FROM b JOIN r USING (series)""",
)
def _(spark, d):
    return rounded(evidence.kpss(hours(spark, d)))


@query(
    "stationarity_differenced",
    f"""WITH {HOURS}, o AS (SELECT series, idx, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS v FROM s), z AS (SELECT series, idx, v - lag(v, 24) OVER (PARTITION BY series ORDER BY idx) AS v FROM o WHERE v IS NOT NULL), k AS (SELECT * FROM z WHERE v IS NOT NULL),
    y AS (SELECT series, lag(v) OVER (PARTITION BY series ORDER BY idx) AS x, v - lag(v) OVER (PARTITION BY series ORDER BY idx) AS y FROM k), r AS (SELECT series, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, count(*) AS n FROM y WHERE x IS NOT NULL GROUP BY series)
    SELECT series, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 5) AS t, b / sqrt((syy - b * sxy) / (n - 2) / sxx) < -2.86 AS stationary FROM r""",
)
def _(spark, d):
    return rounded(descriptive.stationarity(evidence.differenced(hours(spark, d), 1, 24)), 5)


def _compared(width: str, season: int, name: str = "cmp") -> str:
    """CTEs that end in one of the given name: series, width, property, estimate, low, high, direction."""
    z, p = evidence.Z90, name
    return f"""{p}n AS (SELECT series, count(*) AS n FROM s GROUP BY series), {p}w AS (SELECT series, n, least({width}, n // 2) AS w FROM {p}n WHERE least({width}, n // 2) >= {max(6, season)}),
    {p}u AS (SELECT series, greatest({SCALE_B.format('v')} / sqrt(2), 1e-12) AS unit FROM fd WHERE v IS NOT NULL GROUP BY series),
    {p}d AS (SELECT s.series, w, value, idx >= n - w AS late, idx - CASE WHEN idx >= n - w THEN n - w ELSE n - 2 * w END AS pos FROM s JOIN {p}w USING (series) WHERE idx >= n - 2 * w),
    {p}l AS (SELECT series, late, any_value(w) AS w, regr_slope(value, pos) AS b, sqrt(greatest(0, regr_syy(value, pos) - regr_slope(value, pos) * regr_sxy(value, pos)) / (count(*) - 2) / regr_sxx(value, pos)) AS bse, median(value) AS m, {SCALE_B.format('value')} AS sc FROM {p}d GROUP BY series, late),
    {p}x AS (SELECT d.*, value - b * pos AS x FROM {p}d d JOIN {p}l l USING (series, late)), {p}r AS (SELECT *, x - CASE WHEN {season} > 1 AND w >= {2 * season} THEN avg(x) OVER (PARTITION BY series, late, pos % {max(season, 1)}) ELSE median(x) OVER (PARTITION BY series, late) END AS r FROM {p}x),
    {p}s AS (SELECT series, late, {SCALE_B.format('r')} AS rs FROM {p}r GROUP BY series, late), {p}f AS (SELECT r.series, r.late, count(*) FILTER (abs(r) > 3.5 * greatest(q.rs, 1e-12)) AS far FROM {p}r r JOIN {p}s q ON q.series = r.series AND NOT q.late GROUP BY ALL),
    {p}a AS (SELECT l.*, rs, far FROM {p}l l JOIN {p}s USING (series, late) JOIN {p}f USING (series, late)),
    {p}e AS (SELECT a.series, a.w, (a.m - c.m) / unit AS level, 1.2533 * sqrt(power(c.sc, 2) / a.w + power(a.sc, 2) / a.w) / unit AS lse, (a.b - c.b) / unit AS trend, sqrt(power(c.bse, 2) + power(a.bse, 2)) / unit AS tse, a.rs / c.rs AS ratio, 1.64 * sqrt(1 / (a.w - 1)) AS rse, (a.far - c.far) / a.w AS ext,
      sqrt((c.far + .5) / (a.w + 1) * (1 - (c.far + .5) / (a.w + 1)) / a.w + (a.far + .5) / (a.w + 1) * (1 - (a.far + .5) / (a.w + 1)) / a.w) AS ese FROM {p}a a JOIN {p}a c ON a.series = c.series AND a.late AND NOT c.late JOIN {p}u u ON u.series = a.series WHERE c.rs > 1e-12),
    {p}i AS (SELECT *, level - {z} * lse AS l0, level + {z} * lse AS l1, trend - {z} * tse AS t0, trend + {z} * tse AS t1, greatest(abs(level), abs(trend)) AS strength FROM {p}e),
    {p} AS (SELECT series, w AS width, 'level' AS property, level AS estimate, l0 AS low, l1 AS high, CASE WHEN level > .25 THEN 'higher' WHEN level < -.25 THEN 'lower' ELSE 'similar' END AS direction FROM {p}i
      UNION ALL SELECT series, w, 'trend', trend, t0, t1, CASE WHEN trend > .02 THEN 'upward' WHEN trend < -.02 THEN 'downward' ELSE 'constant' END FROM {p}i
      UNION ALL SELECT series, w, 'volatility', ratio, CASE WHEN ratio > 0 THEN exp(ln(ratio) - {z} * rse) END, CASE WHEN ratio > 0 THEN exp(ln(ratio) + {z} * rse) END, CASE WHEN ratio > 1.25 THEN 'increased' WHEN ratio < .8 THEN 'decreased' ELSE 'stable' END FROM {p}i
      UNION ALL SELECT series, w, 'regime', strength, greatest(CASE WHEN l0 * l1 > 0 THEN least(abs(l0), abs(l1)) ELSE 0 END, CASE WHEN t0 * t1 > 0 THEN least(abs(t0), abs(t1)) ELSE 0 END), greatest(abs(l0), abs(l1), abs(t0), abs(t1)), CASE WHEN strength >= 1 THEN 'shift' ELSE 'no_shift' END FROM {p}i
      UNION ALL SELECT series, w, 'extreme', ext, ext - {z} * ese, ext + {z} * ese, CASE WHEN ext > .02 THEN 'increased' WHEN ext < -.02 THEN 'decreased' ELSE 'stable' END FROM {p}i)"""


SUPPORT = """CASE WHEN CASE WHEN property = 'level' THEN CASE WHEN direction = 'similar' THEN low >= -.25 AND high <= .25 ELSE abs(estimate) >= .75 END WHEN property = 'trend' THEN CASE WHEN direction = 'constant' THEN low >= -.02 AND high <= .02 ELSE abs(estimate) >= .06 END
    WHEN property = 'volatility' THEN CASE direction WHEN 'increased' THEN estimate >= 1.5 WHEN 'decreased' THEN estimate <= .67 ELSE low >= .8 AND high <= 1.25 END WHEN property = 'regime' THEN CASE WHEN direction = 'shift' THEN estimate >= 1.5 AND low >= 1 ELSE high < 1 END
    ELSE CASE WHEN direction = 'stable' THEN low >= -.01 AND high <= .01 ELSE abs(estimate) >= .04 AND (low > 0 OR high < 0) END END THEN 'supported' ELSE 'weak' END"""


@query("window_evidence", f"WITH {HOURS}, {DIFFS}, {_compared('48', 24)} SELECT series, width, property, round(estimate, 5) AS estimate, round(low, 5) AS low, round(high, 5) AS high, direction, {SUPPORT} AS support FROM cmp")
def _(spark, d):
    return rounded(evidence.supported(evidence.compared(hours(spark, d), 24)), 5)


def _resolutions(season: int) -> str:
    widths = (str(max(8, season)), str(max(16, 2 * season)), str(max(24, 4 * season)), f"greatest(32, least(n // 2, {8 * season}))")
    ctes = ", ".join(_compared(w, season, f"q{i}") for i, w in enumerate(widths))
    rows = " UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(4))
    return f"""WITH {HOURS}, {DIFFS}, {ctes}, allq AS (SELECT DISTINCT ON (series, width, property) * FROM ({rows})), sup AS (SELECT *, {SUPPORT} AS support FROM allq), vt AS (SELECT series, property, direction, sum(CASE support WHEN 'supported' THEN 2.0 ELSE 1.0 END) AS score, count(*) AS n FROM sup GROUP BY ALL),
    tt AS (SELECT series, property, first(direction ORDER BY score DESC, direction) AS best, max(score) AS score, sum(score) AS total, CAST(sum(n) AS BIGINT) AS resolutions, count(*) > 1 AS diverges FROM vt GROUP BY ALL),
    mr AS (SELECT series, property, CASE WHEN score / total > .5 THEN best ELSE 'uncertain' END AS direction, CASE WHEN resolutions >= 2 AND score / total >= .75 AND score >= 3 THEN 'supported' WHEN score / total > .5 THEN 'weak' ELSE 'abstained' END AS support, score / total AS agreement, diverges, resolutions FROM tt)"""


@query("multi_resolution", _resolutions(24) + " SELECT series, property, direction, support, round(agreement, 6) AS agreement, diverges, resolutions FROM mr")
def _(spark, d):
    return rounded(evidence.multi_resolution(hours(spark, d), 24))


@query(
    "hypotheses",
    _resolutions(24)
    + """, hy AS (SELECT *, agreement * CASE support WHEN 'supported' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END AS score FROM mr WHERE direction NOT IN ('uncertain', 'similar', 'constant', 'stable', 'no_shift')), rk AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, property) AS rank FROM hy) SELECT series, rank, property, direction, support, round(score, 6) AS score FROM rk WHERE rank <= 3""",
)
def _(spark, d):
    return rounded(evidence.hypotheses(evidence.multi_resolution(hours(spark, d), 24)))


@query(
    "consensus",
    f"""WITH {HOURS}, {DIFFS}, {_compared('48', 24)}, c AS (SELECT property, direction, count(*) AS n, median(estimate) AS estimate FROM cmp GROUP BY ALL), t AS (SELECT property, first(direction ORDER BY n DESC, direction DESC) AS best, max(n) AS n, first(estimate ORDER BY n DESC, direction DESC) AS estimate, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY property)
    SELECT property, CASE WHEN n / total > .5 THEN best ELSE 'uncertain' END AS direction, CASE WHEN total >= 5 AND n / total >= .8 THEN 'supported' WHEN n / total > .5 THEN 'weak' ELSE 'abstained' END AS support, total AS effective_series, round(n / total, 6) AS agreement, round(estimate, 5) AS estimate FROM t""",
)
def _(spark, d):
    x = evidence.consensus(evidence.compared(hours(spark, d), 24))
    return rounded(x.withColumn("agreement", F.round("agreement", 6)).withColumn("estimate", F.round("estimate", 5)))


@query(
    "momentum",
    f"""WITH {HOURS}, n AS (SELECT series, count(*) AS n, CAST(greatest(24, least(48, count(*) // 5)) AS BIGINT) AS w FROM s GROUP BY series), k AS (SELECT *, greatest(8, w // 2) AS st FROM n), e AS (SELECT series, w, unnest(range(greatest(w, n - 4 * st), n + 1, st)) AS e FROM k WHERE n >= w + 3 * st),
    p AS (SELECT e.series, e, ln(greatest({SCALE_B.format('value')}, 1e-12)) AS y FROM e JOIN s ON s.series = e.series AND idx >= e - w AND idx < e GROUP BY ALL), sl AS (SELECT a.series, median((b.y - a.y) / (b.e - a.e)) AS slope FROM p a JOIN p b ON a.series = b.series AND b.e > a.e GROUP BY a.series),
    ad AS (SELECT series, y - lag(y) OVER (PARTITION BY series ORDER BY e) AS st, last_value(y) OVER (PARTITION BY series ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(y) OVER (PARTITION BY series ORDER BY e) AS net FROM p), pe AS (SELECT series, abs(any_value(net)) >= .15 AND count(*) FILTER (st * net > 0) >= 2 AS persistent FROM ad GROUP BY series)
    SELECT n.series, round(coalesce(slope, 0), 6) AS slope, coalesce(persistent, false) AS persistent FROM n LEFT JOIN sl USING (series) LEFT JOIN pe USING (series)""",
)
def _(spark, d):
    return rounded(evidence.momentum(hours(spark, d)))


PRINTS = f"""t AS (SELECT *, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS d FROM s), u AS (SELECT *, d * lag(d) OVER (PARTITION BY series ORDER BY idx) < 0 AS turn FROM t),
    fp AS (SELECT series, count(*) AS length, round(regr_slope(value, idx) / {SCALE_A.format('value')}, 4) AS trend, round({SCALE_A.format('value')} / abs(median(value)), 4) AS noise_ratio, round(avg(CAST(value = 0 AS INTEGER)), 4) AS intermittency, round(count(*) FILTER (turn) / greatest(1, count(*) - 2), 4) AS direction_change_rate FROM u GROUP BY series)"""


@query("fingerprint", f"WITH {HOURS}, {PRINTS} SELECT * FROM fp")
def _(spark, d):
    return rounded(evidence.fingerprint(hours(spark, d)), 4)


@query(
    "fingerprint_distance",
    f"WITH {HOURS}, {PRINTS} SELECT a.series AS series_a, b.series AS series_b, round(sqrt(power(a.trend - b.trend, 2) + power(a.noise_ratio - b.noise_ratio, 2) + power(a.intermittency - b.intermittency, 2) + power(a.direction_change_rate - b.direction_change_rate, 2) + power(log10(a.length) - log10(b.length), 2)), 4) AS distance FROM fp a, fp b",
)
def _(spark, d):
    fp = evidence.fingerprint(hours(spark, d))
    return rounded(evidence.fingerprint_distance(fp, fp), 4)


@query(
    "regime_bins",
    f"""WITH {DAYS}, x AS (SELECT *, abs(value - lag(value) OVER w) AS d, abs(value - lag(value, 7) OVER w) AS s7, count(*) OVER (PARTITION BY series) AS n FROM s WINDOW w AS (PARTITION BY series ORDER BY idx)),
    a AS (SELECT series, any_value(n) AS n, greatest(max(value) - min(value), 1e-12) AS span, abs(arg_max(value, idx) - arg_min(value, idx)) / greatest(any_value(n) - 1, 1) AS st, avg(CAST(abs(value) <= 1e-12 AS INTEGER)) AS z, avg(d) AS nv, avg(s7) AS sv, avg(d) FILTER (idx - 1 < (n - 1) // 2) AS l, avg(d) FILTER (idx - 1 >= (n - 1) // 2) AS r FROM x GROUP BY series)
    SELECT series, 'daily_weekly' AS frequency_class, CASE WHEN n / 14 < 1 THEN 'lt_1' WHEN n / 14 < 2 THEN '1_to_2' WHEN n / 14 < 4 THEN '2_to_4' ELSE 'gte_4' END AS history_horizon_ratio, CASE WHEN n < 14 THEN 'unknown' WHEN sv / greatest(nv, 1e-12) < .6 THEN 'high' WHEN sv / greatest(nv, 1e-12) < 1 THEN 'moderate' ELSE 'low' END AS seasonality_strength,
    CASE WHEN st / span < .005 THEN 'low' WHEN st / span < .02 THEN 'moderate' ELSE 'high' END AS trend_strength, CASE WHEN z >= .4 THEN 'high' WHEN z >= .1 THEN 'moderate' ELSE 'low' END AS intermittency, CASE WHEN n < 5 THEN 'unknown' WHEN greatest(l, r) / greatest(least(l, r), 1e-12) < 2 THEN 'stable' ELSE 'changing' END AS scale_stability FROM a""",
)
def _(spark, d):
    return rounded(evidence.regime_bins(days(spark, d), 14, 7, "D"))


@query(
    "label_grades",
    f"""WITH {HOURS}, z AS (SELECT series, idx, value, abs(value - median(value) OVER (PARTITION BY series)) AS dev FROM s), f AS (SELECT series, idx FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dev DESC, idx) AS k FROM z) WHERE k <= 20), l AS (SELECT series, idx FROM s WHERE idx % 37 = 5),
    p AS (SELECT f.series, count(*) AS flagged, count(*) FILTER (EXISTS (SELECT 1 FROM l WHERE l.series = f.series AND abs(l.idx - f.idx) <= 1)) AS ok FROM f GROUP BY f.series), r AS (SELECT l.series, count(*) AS labelled, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE l.series = f.series AND abs(l.idx - f.idx) <= 1)) AS found FROM l GROUP BY l.series)
    SELECT r.series, flagged, labelled, round(ok / flagged, 6) AS precision, round(found / labelled, 6) AS recall, round(coalesce(2 * (ok / flagged) * (found / labelled) / nullif(ok / flagged + found / labelled, 0), 0), 6) AS f1 FROM r JOIN p USING (series)""",
)
def _(spark, d):
    from pyspark.sql import Window

    s = hours(spark, d)
    dev = F.abs(F.col("value") - F.percentile("value", F.lit(0.5)).over(Window.partitionBy("series")))
    top = s.withColumn("dev", dev).withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.col("dev").desc(), "idx"))).where("k <= 20")
    return rounded(evidence.label_grades(top.select("series", "idx"), s.where("idx % 37 = 5").select("series", "idx")))


@query("seasonal_envelope", f"WITH {HOURS} SELECT series, idx % 24 AS phase, round(quantile_cont(value, 0.9), 6) AS level FROM s GROUP BY ALL")
def _(spark, d):
    return rounded(evidence.seasonal_envelope(hours(spark, d), 24))


@query("phase_trend", f"WITH {HOURS}, x AS (SELECT series, idx - avg(idx) OVER w AS x, value - avg(value) OVER w AS y FROM s WINDOW w AS (PARTITION BY series, idx % 24)) SELECT series, round(sum(x * y) / sum(x * x), 6) AS slope FROM x GROUP BY series")
def _(spark, d):
    return rounded(evidence.phase_trend(hours(spark, d), 24))


@query("innovation_scale", f"WITH {HOURS}, {DIFFS} SELECT series, round(1.4826 * mad(v), 6) AS scale FROM fd WHERE v IS NOT NULL GROUP BY series")
def _(spark, d):
    return rounded(evidence.innovation_scale(hours(spark, d)))


@query(
    "future_grid",
    f"WITH {ORDER_DAYS}, l AS (SELECT series, max(ts) AS last FROM s GROUP BY series), k AS (SELECT unnest(range(1, 6)) AS step) SELECT series || '/D' AS series, step, CAST(last + CAST(step AS INTEGER) AS DATE) AS ts FROM l, k UNION ALL SELECT series || '/W', step, CAST(last + CAST(7 * step AS INTEGER) AS DATE) FROM l, k UNION ALL SELECT series || '/MS', step, CAST(date_trunc('month', last) + to_months(CAST(step AS INTEGER)) AS DATE) FROM l, k",
)
def _(spark, d):
    s = order_days(spark, d)
    out = None
    for step in ("D", "W", "MS"):
        part = evidence.future_grid(s.withColumn("series", F.concat("series", F.lit(f"/{step}"))), 5, step)
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("future_grid_hours", f"WITH {HOURS}, l AS (SELECT series, max(ts) AS last FROM s GROUP BY series), k AS (SELECT unnest(range(1, 4)) AS step) SELECT series, step, last + to_hours(CAST(6 * step AS INTEGER)) AS ts FROM l, k")
def _(spark, d):
    return rounded(evidence.future_grid(hours(spark, d), 3, "6h"))


@query(
    "combined_quantiles",
    f"""WITH {FOLDS}, q AS (SELECT series, origin * 10 + lead AS step, level, predicted + off AS value FROM bt, (VALUES (0.1::DOUBLE, -5.0::DOUBLE), (0.5, 0.0), (0.9, 5.0)) v(level, off))
    SELECT series, step, level, round(CASE WHEN any_value(level) <= .5 THEN min(value) ELSE max(value) END, 6) AS widest, round(CASE WHEN any_value(level) <= .5 THEN max(value) ELSE min(value) END, 6) AS narrowest, round(avg(value), 6) AS mean FROM q GROUP BY series, step, level""",
)
def _(spark, d):
    bt = evaluate.backtest(days(spark, d), H, SEASON, LINEAR)
    levels = F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("off")) for a, b in ((0.1, -5.0), (0.5, 0.0), (0.9, 5.0))]))
    q = bt.withColumn("l", levels).select("series", (F.col("origin") * 10 + F.col("lead")).alias("step"), "model", "l.level", (F.col("predicted") + F.col("l.off")).alias("value"))
    parts = [evaluate.combine_quantiles(q, how).withColumnRenamed("value", name) for how, name in (("union", "widest"), ("intersection", "narrowest"), ("mean", "mean"))]
    return rounded(parts[0].join(parts[1], ["series", "step", "level"]).join(parts[2], ["series", "step", "level"]))
