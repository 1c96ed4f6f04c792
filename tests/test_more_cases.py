"""Models, detectors, questions, sources and sinks against plain loops and planted cases."""

import datetime as dt
import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import api
from tidewater.functions.stats import isotonic
from tidewater.operators import anomalies, context, evaluate, models, multivariate, quality, questions, recursive
from tidewater.sources.readers import infer_columns, inline, read_events, read_table
from tidewater.sources.sinks import forecast_columns, redacted, value_id, write_artifact, write_forecast


def rows(spark, named):
    at = [(s, i, dt.date(2026, 1, 1) + dt.timedelta(days=i), float(v)) for s, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(at, "series string, idx long, ts date, value double")


def wave(n, seed=0):
    r = random.Random(seed)
    return [100 + 10 * (i % 7) + 0.3 * i + r.gauss(0, 1) for i in range(n)]


def test_many_folds_at_once_as_one_by_one(spark):
    h = [wave(n, n) for n in (1, 3, 4, 9, 17, 18, 40, 40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(h)], "i int, past array<double>")
    got = recursive.with_predictions(df, ["theta", "ets"], 5, 7).collect()
    want = df.select("i", models.theta(F.col("past"), 5, 7).alias("theta"), models.ets(F.col("past"), 5, 7).alias("ets")).collect()
    one = {r["i"]: r for r in want}
    for r in got:
        for name in ("theta", "ets"):
            a, b = r[f"p_{name}"], one[r["i"]][name]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9)), (r["i"], name)


def test_isotonic_against_pools(spark):
    r = random.Random(2)
    lists = [[r.randint(0, 9) + 0.0 for _ in range(n)] for n in (0, 1, 2, 5, 8, 8, 20)]

    def pooled(v):
        blocks = []
        for x in v:
            blocks.append([x, 1])
            while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
        return [m for m, c in blocks for _ in range(c)]

    got = [x["x"] for x in spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<double>").orderBy("i").select(isotonic(F.col("v")).alias("x")).collect()]
    for g, v in zip(got, lists, strict=True):
        assert g == pytest.approx(pooled(v))


def test_series_of_all_lengths_get_forecasts_with_dates(spark):
    df = rows(spark, {"long": wave(90), "short": wave(20), "tiny": [5.0, 6.0], "one": [3.0]}).drop("idx")
    got = api.forecast(df, 4, 7, step="D").collect()
    tier = {r["series"]: r["tier"] for r in got}
    assert len(got) == 16 and tier["tiny"] == tier["one"] == "best_effort" and tier["short"] == "conditionally_supported" and tier["long"] in ("supported", "conditionally_supported")
    assert {r["ts"] for r in got if r["series"] == "tiny"} == {dt.date(2026, 1, 3 + k) for k in range(4)}
    assert all(r["q05"] <= r["q10"] <= r["q50"] <= r["q90"] <= r["q95"] for r in got)
    assert all(r["model"] in models.BASELINES for r in got if r["series"] == "short")


def test_changes_are_ranked(spark):
    r = random.Random(4)
    v = [10 + r.gauss(0, 1) for _ in range(40)] + [30 + r.gauss(0, 1) for _ in range(40)] + [36 + r.gauss(0, 1) for _ in range(40)]
    got = sorted(api.investigate(rows(spark, {"a": v}).drop("idx")).collect(), key=lambda x: x["rank"])
    assert [x["split"] for x in got][:2] == [40, 80] and got[0]["dominant"] and got[0]["regime"] == "regime_shift"


def test_vector_autoregression_against_least_squares(spark):
    rng = np.random.default_rng(1)
    x = [np.array([1.0, 2.0])]
    for _ in range(60):
        x.append(np.array([[0.6, 0.3], [0.2, 0.5]]) @ x[-1] + rng.normal(0, 0.2, 2))
    x = np.array(x)
    df = rows(spark, {"a": x[:, 0], "b": x[:, 1]}).withColumn("panel", F.lit("p"))
    got = {(r["series"], r["step"]): r["point"] for r in multivariate.var_forecast(df, 3).collect()}
    b, *_ = np.linalg.lstsq(np.column_stack([np.ones(60), x[:-1]]), x[1:], rcond=None)
    state = x[-1]
    for k in range(3):
        state = np.append(1.0, state) @ b
        assert [got["a", k + 1], got["b", k + 1]] == pytest.approx(list(state), rel=1e-4)
    assert multivariate.var_forecast(df.where("series = 'a'"), 3).first()["problem"] == "fewer than two series"


def test_weights_are_not_negative():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.normal(size=(30, 4)) + 2
        y = x @ np.array([0.7, 0.5, -0.4, 0.0]) + rng.normal(0, 0.1, 30)
        w = multivariate.non_negative(x, y)
        g, best = x.T @ x + 1e-6 * np.eye(4), np.full(4, 0.25)
        for _ in range(20_000):
            best = np.maximum(0, best - (g @ best - x.T @ y) / np.abs(g).sum(axis=1).max())
        assert (w >= 0).all() and ((x @ w - y) ** 2).sum() <= ((x @ best - y) ** 2).sum() + 1e-6


def test_stacking_finds_the_right_model(spark):
    bt = evaluate.backtest(rows(spark, {"a": [100 + 3 * i for i in range(60)]}), 3, 7, ("last_value", "drift", "window_average"))
    w = {r["model"]: r["weight"] for r in multivariate.stacking_weights(bt).collect()}
    assert w["drift"] == pytest.approx(1.0, abs=1e-4)


def test_regression_against_least_squares(spark):
    r = random.Random(6)
    x = [r.random() for _ in range(80)]
    df = rows(spark, {"a": [3 + 2 * v + r.gauss(0, 0.05) for v in x]}).join(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "idx long, x double"), "idx")
    got = {r["term"]: r for r in multivariate.regression(df, "value", ["x"]).collect()}
    assert got["x"]["low"] < 2 < got["x"]["high"] and got["intercept"]["coefficient"] == pytest.approx(3, abs=0.1) and got["x"]["skill"] > 0.9
    assert multivariate.regression(df.where("idx < 10"), "value", ["x"]).count() == 0


def test_covariates_carry_the_forecast(spark):
    x = [(i * 37 % 11) / 11 for i in range(90)]
    v = [5 + 4 * a for a in x]
    past = rows(spark, {"a": v[:80]}).withColumn("x", (F.col("idx") * 37 % 11) / 11)
    ahead = spark.createDataFrame([("a", k + 1, x[80 + k]) for k in range(10)], "series string, step long, x double")
    got = multivariate.covariate_forecast(past, ahead, ["x"], 7).orderBy("step").collect()
    assert [r["point"] for r in got] == pytest.approx(v[80:], abs=0.05)


def test_graded_detection(spark):
    r = random.Random(8)
    v = [10 + r.gauss(0, 1) for _ in range(200)]
    v[120] = 40.0
    got = anomalies.detected(rows(spark, {"a": v, "b": [1.0] * 5})).collect()
    assert [x["idx"] for x in got if x["anomalous"]] == [120] and {x["status"] for x in got if x["series"] == "b"} == {"inconclusive"}
    best = next(x for x in got if x["series"] == "a")
    assert best["grade"] == max(g for g, dense in anomalies.grades(np.array(v), 1).values() if not dense)
    again = anomalies.detected(rows(spark, {"a": v})).select("detector", "grade").first()
    assert (again["detector"], again["grade"]) == (best["detector"], best["grade"])


def test_detectors_against_loops():
    r = random.Random(9)
    v = np.array([r.gauss(0, 1) + (i % 6) for i in range(90)])
    x = np.array([v[i] - np.median(v[max(0, i - 3) : i + 4]) for i in range(90)])
    assert anomalies.level_scores(v, 6) == pytest.approx(x / max(1.4826 * np.median(np.abs(x - np.median(x))), 1e-12))
    d = np.diff(v)
    s = np.array([np.median(d[max(0, i - 6) : i + 7]) for i in range(89)])
    s -= np.median(s)
    s /= max(1.4826 * np.median(np.abs(s - np.median(s))), 1e-12)
    assert anomalies.slope_scores(v, 6) == pytest.approx(np.append(s, s[-1]))
    scores = anomalies.step_scores(v, 6)
    assert (scores[:8] == 0).all() and len(scores) == 90
    one = anomalies.prefix_theta(v)
    assert [one[k - 1] for k in range(2, 91)] == pytest.approx([recursive.theta(v[None, :k], 1, 6)[0, 0] for k in range(2, 91)])
    long = np.array([r.gauss(0, 1) for _ in range(1300)])
    first, errors = 8, []
    for at in range(first, 1300):
        errors.append(long[at] - recursive.theta(long[None, max(0, at - anomalies.TRAINED) : at], 1, 1)[0, 0])
    naive = long[first:] - long[first - 1 : -1]
    e = min((naive, np.array(errors)), key=lambda x: np.abs(x).mean())
    assert anomalies.step_scores(long, 1)[first:] == pytest.approx(e / max(1.4826 * np.median(np.abs(e - np.median(e))), 1e-12))


def test_questions_say_what_is_wrong(spark):
    for raw, field in (({"verb": "guess", "property": "level", "target": "a"}, "verb"), ({"property": "mood", "target": "a"}, "property"), ({"property": "trend", "target": "z"}, "target.members"), ({"property": "trend", "target": "a", "horizon": 0}, "horizon"), ({"property": "level", "target": {"kind": "aggregate", "members": ["a", "b"]}}, "target.aggregation")):
        with pytest.raises(questions.QuestionError) as e:
            questions.compiled(raw, ["a", "b"])
        assert field in e.value.failures
    q = questions.compiled({"property": "growth"}, ["a"])
    assert (q.property, q.members) == ("trend", ("a",)) and questions.planned(q)["status"] == "ready"
    assert questions.planned(questions.compiled({"verb": "test", "property": "stationarity", "method": "magic"}, ["a"]))["status"] == "unsupported"
    assert api.ask(rows(spark, {"a": wave(60)}).drop("idx"), {"property": "level", "target": "a", "period": 7}).count() == 1


def test_sources_of_many_forms(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("when;amount\n2026-01-01;1\n2026-01-02;2\n")
    assert [r["amount"] for r in read_table(spark, f"{tmp_path}/a.csv.gz", columns=("when", "amount")).orderBy("when").collect()] == ["1", "2"]
    (tmp_path / "b.csv").write_bytes("name,amount\ncafé,1\n".encode("cp1252"))
    assert read_table(spark, f"{tmp_path}/b.csv", columns=("name", "amount")).first()["name"] == "café"
    (tmp_path / "u.csv").write_text("name,amount\ncafé,1\n", encoding="utf-8")
    assert read_table(spark, f"{tmp_path}/u.csv", columns=("name", "amount")).first()["name"] == "café"
    (tmp_path / "c.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert read_table(spark, f"{tmp_path}/c.json").count() == 2
    (tmp_path / "d.ndjson").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert read_table(spark, f"{tmp_path}/d.ndjson").count() == 2
    with pytest.raises(ValueError):
        read_table(spark, f"{tmp_path}/e.xlsx")
    given = inline(spark, [{"t": "2026-01-01", "v": "1"}, {"t": "2026-01-02", "v": 2, "n": "x"}])
    assert infer_columns(given) == ("t", "v")
    events = {"schema_version": "1", "events": [{"event_id": "e", "entity_scope": ["*"], "effective_start": "2026-01-01T00:00:00", "effective_end": "2026-01-03T00:00:00", "known_at": "2025-12-31T00:00:00", "status": "confirmed", "attributes": {"claim": {"kind": "max", "value": 5.0}}, "source": {"type": "desk", "reference": "r1"}}]}
    (tmp_path / "events.json").write_text(json.dumps(events))
    e = read_events(spark, f"{tmp_path}/events.json").first()
    assert (e["event_id"], e["kind"], e["value"], e["source"]) == ("e", "max", 5.0, "r1")


def test_sinks_keep_the_first_write(spark, tmp_path):
    df = rows(spark, {"a": [1.0, 2.0]})
    name = write_artifact(df, str(tmp_path))
    before = sorted(p.name for p in (tmp_path / name).iterdir())
    assert write_artifact(df.repartition(2), str(tmp_path)) == name and sorted(p.name for p in (tmp_path / name).iterdir()) == before
    f = spark.createDataFrame([("a", "t", 1.0, 0.5, 1.0, 1.5, 0.2, "supported")], "series string, timestamp string, q50 double, q10 double, point double, q90 double, q05 double, tier string")
    assert forecast_columns(f).columns == ["series", "timestamp", "point", "q10", "q50", "q90", "q05", "tier"]
    where = write_forecast(f, str(tmp_path), [{"b": 1, "a": 2}])
    assert spark.read.text(f"{tmp_path}/{where}/evidence").first()["value"] == '{"a":2,"b":1}'
    assert value_id("x", {"a": 1, "b": 2}) == value_id("x", {"b": 2, "a": 1}) != value_id("y", {"a": 1, "b": 2})
    text = spark.createDataFrame([("Bearer abc.def a@b.org C:\\x\\y " + "f" * 32,)], "t string").select(redacted(F.col("t")).alias("t")).first()["t"]
    assert text == "Bearer [REDACTED] [EMAIL] [PATH] [TOKEN]"


def test_frequencies_and_specs():
    assert quality.normalise_frequency("hourly") == "h" and quality.normalise_frequency("7min") == "7min" and api.default_season("2h") == 12 and api.default_season("MS") == 12 and api.default_season("7h") == 3
    with pytest.raises(ValueError):
        quality.normalise_frequency("fortnight")
    assert context.covariate_specs("a:continuous:future_known, b:cyclic_7:future_known") == [("a", "continuous"), ("b", "cyclic_7")]
    for bad in ("a:continuous", "a:odd:future_known", "a:binary:observed", "a:cyclic_0:future_known", "a:binary:future_known,a:binary:future_known"):
        with pytest.raises(ValueError):
            context.covariate_specs(bad)


def test_day_first_needs_evidence(spark):
    column = lambda *v: spark.createDataFrame([(x,) for x in v], "d string")
    assert quality.day_first(column("13/06/2026", "01/02/2026"), "d") is True
    assert quality.day_first(column("06/13/2026"), "d") is False and quality.day_first(column("01/02/2026"), "d") is None
    with pytest.raises(ValueError):
        quality.day_first(column("13/06/2026", "06/13/2026"), "d")
