"""Admission, bounds in words, volatility, adapters, settings and worlds with a known answer."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import adapters, api, config, registry
from tidewater.functions import spans
from tidewater.operators import admission, bitemporal, episodes, evaluate, ledger, volatility
from tidewater.sources import refs
from tidewater.sources.sinks import write_forecast

DAY = dt.date(2026, 1, 1)


def test_bounds_are_read_from_words(spark):
    cases = {
        "between 40 and 60": (40, 60),
        "no more than 60": (None, 60),
        "at most 1,200 units": (None, 1200),
        "it will not stay below 100": (100, None),
        "sales cannot be negative": (0, None),
        "non-negative and at most 5.5": (0, 5.5),
        "never exceed 3": (None, 3),
        "more than 7": (7, None),
        "a fine day": (None, None),
        "at least 9 but at most 2": (9, 2),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", spans.bounds(F.col("t")).alias("b"))
    for r in df.collect():
        assert (r["b"]["minimum"], r["b"]["maximum"]) == cases[r["t"]], r
        assert (r["b"]["problem"] is not None) == (cases[r["t"]] in ((None, None), (9, 2)))
    t = spark.createDataFrame([("3 times the usual level", "2026-01-05: 1,200 and 2026-01-06 = 7",)], "a string, b string")
    got = t.select(spans.times_of(F.col("a")).alias("x"), spans.schedule(F.col("b")).alias("s")).first()
    assert got["x"] == 3 and [(r["date"], r["value"]) for r in got["s"]] == [(dt.date(2026, 1, 5), 1200.0), (dt.date(2026, 1, 6), 7.0)]


def test_normal_cdf(spark):
    z = [-6.0, -2.5, -1.0, 0.0, 0.3, 1.96, 5.0]
    got = [r["p"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(z)], "i int, z double").orderBy("i").select(ledger.normal_cdf(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z], abs=1e-6)


def test_admission_states(spark):
    cols = "key string, valid boolean, folds int, gain double, gain_se double, win_rate double, median_gain double, prior_gain double, prior_se double, relevance double"
    rows = [
        ("invalid", False, 5, 0.2, 0.01, 1.0, 0.2, 0.2, 0.01, 1.0),
        ("local", True, 5, 0.2, 0.01, 1.0, 0.2, None, None, None),
        ("joint", True, 5, 0.2, 0.01, 1.0, 0.2, 0.1, 0.01, 1.0),
        ("external", True, 0, None, None, None, None, 0.1, 0.01, 1.0),
        ("assisted", True, 1, 0.1, None, None, None, 0.1, 0.05, 0.5),
        ("conflict", True, 1, -0.05, None, None, None, 0.1, 0.05, 1.0),
        ("nothing", True, 0, None, None, None, None, None, None, None),
        ("loses", True, 4, -0.3, 0.01, 0.0, -0.3, None, None, None),
    ]
    got = {r["key"]: r for r in admission.decided(spark.createDataFrame(rows, cols)).collect()}
    state = {k: (r["state"], r["policy"]) for k, r in got.items()}
    assert state == {"invalid": ("baseline_fallback", "baseline"), "local": ("locally_validated", "candidate"), "joint": ("jointly_validated", "candidate"), "external": ("externally_validated", "candidate"), "assisted": ("prior_assisted", "shrunk_blend"), "conflict": ("prior_assisted", "shrunk_blend"), "nothing": ("baseline_fallback", "baseline"), "loses": ("baseline_fallback", "baseline")}
    assert 0 < got["conflict"]["weight"] <= 0.5 and got["assisted"]["weight"] <= 0.5


def test_output_diagnostics(spark):
    h = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "series string, idx long, value double")
    p = spark.createDataFrame([("a", k, [12.0, 10.0, 12.0, 10.0][k - 1], 10.0) for k in range(1, 5)], "series string, step long, candidate double, baseline double")
    r = admission.output_diagnostics(h, p).first()
    assert (r["boundary_jump"], r["scale_ratio"], r["oscillation_ratio"], r["disagreement"]) == (3.0, 2.0, 1.0, 1.0)
    assert not admission.output_diagnostics(h, p.withColumn("candidate", F.lit(float("nan")))).first()["valid"]


def test_volatility_of_a_growing_series(spark):
    r = random.Random(3)
    loud, calm = [r.gauss(0, 1 + 0.06 * i) for i in range(240)], [r.gauss(0, 1) for _ in range(240)]
    df = spark.createDataFrame([(s, i, v) for s, x in (("loud", loud), ("calm", calm), ("short", calm[:20])) for i, v in enumerate(x)], "series string, idx long, value double")
    got = {x["series"]: x for x in volatility.forecast(df, 12).collect()}
    assert got["short"]["support"] == "abstained" and got["short"]["model"] is None
    assert got["loud"]["folds"] == len(range(24, 237 - 12 + 1, 12)) and got["loud"]["ratio"] > 0
    assert sum(got["calm"][f"p_{d}"] for d in volatility.DIRECTIONS) == pytest.approx(1)


def test_volatility_pieces_against_loops():
    r = random.Random(5)
    x = np.array([r.gauss(0, 1) for _ in range(70)])
    v = volatility.scale(x[:35]) ** 2
    for item in x[35:]:
        v = 0.15 * item * item + 0.85 * v
    got = volatility.candidates(x, 5, 7)
    assert got["ewma"] == pytest.approx(v**0.5) and got["constant"] == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x))))
    assert set(got) == {"constant", "recent", *volatility.EWMA, "scale_trend", "robust_scale_trend", "regime_mixture", "seasonal_phase"}
    assert volatility.smoothed([2.0, 1.0, 0.5]) == {d: 2 / 6 for d in volatility.DIRECTIONS}
    assert volatility.balanced_accuracy([("stable", "stable"), ("stable", "increased")]) == 0.5
    assert volatility.brier({"decreased": 0.0, "stable": 1.0, "increased": 0.0}, "stable") == 0


def test_adapters_keep_to_their_contract(spark):
    good = adapters.Adapter("mean", lambda h, n, s: [sum(h) / len(h)] * n, min_history=3)
    bad = adapters.Adapter("short", lambda h, n, s: [1.0])
    rude = adapters.Adapter("rude", lambda h, n, s: (h.append(0.0), [1.0] * n)[1])
    assert all(adapters.conformance(good).values())
    assert not adapters.conformance(bad)["finite_exact_horizon"] and not adapters.conformance(rude)["input_immutable"]
    df = spark.createDataFrame([("a", i, DAY + dt.timedelta(days=i), float(i % 7)) for i in range(40)], "series string, idx long, ts date, value double")
    folds = evaluate.folds(df, 3, 7)
    got = adapters.predictions(folds, good, 3, 7).collect()
    assert len(got) == 3 * folds.count() and all(r["predicted"] == pytest.approx(sum(i % 7 for i in range(r["origin"])) / r["origin"]) for r in got)
    assert all(r["predicted"] is None for r in adapters.predictions(folds, bad, 3, 7).collect())
    adapters.register(good)
    assert adapters.eligible(2, 3)["mean"] == "too little history" and adapters.eligible(5, 3)["mean"] is None
    with pytest.raises(ValueError):
        adapters.register(good)


def test_settings_are_checked(tmp_path):
    (tmp_path / "a.toml").write_text('horizon = 3\nmodels = ["theta"]\ntitle = "x"\n')
    c = config.load(str(tmp_path / "a.toml"))
    assert c.horizon == 3 and c.pool == ("last_value", "seasonal_naive", "theta") and c.identity == config.Config(horizon=3, models=("theta",)).identity != config.Config().identity
    (tmp_path / "b.toml").write_text("horizn = 3\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "b.toml"))
    for bad in ({"repair": "wild"}, {"models": ("oracle",)}, {"horizon": 0}):
        with pytest.raises(ValueError):
            config.Config(**bad)


def test_worlds_and_grades(spark):
    w = episodes.worlds(spark, (0,))
    seen = {r["episode"]: r["count"] for r in episodes.visible(w).groupBy("episode").count().collect()}
    assert seen == {"forecastable_0": 40, "abstention_trap_0": 4, "leakage_trap_0": 40, "regime_break_trap_0": 34}
    flat = w.where("episode = 'leakage_trap_0' and not hidden").groupBy("ts").agg(F.max("value").alias("v")).join(episodes.visible(w).where("episode = 'leakage_trap_0'"), "ts")
    assert flat.where("v > value + 20").count() == 1  # the late revision is not seen
    d = spark.createDataFrame([("a", "forecastable", "act", False), ("b", "abstention_trap", "act", False), ("c", "leakage_trap", "act", True), ("d", "regime_break_trap", "warn", False)], "episode string, kind string, action string, saw_hidden boolean")
    assert {r["episode"]: r["passed"] for r in episodes.graded(d).collect()} == {"a": True, "b": False, "c": False, "d": True}
    marks = spark.createDataFrame([("s", i) for i in (1, 2, 3, 7, 9)], "series string, idx long")
    assert [(r["first"], r["last"]) for r in episodes.merged_intervals(marks).orderBy("first").collect()] == [(1, 3), (7, 7), (9, 9)]
    r = episodes.interval_f1(marks, spark.createDataFrame([("s", i) for i in (2, 3, 4)], "series string, idx long")).first()
    assert (r["precision"], r["recall"]) == (0.4, pytest.approx(2 / 3))
    runs = spark.createDataFrame([("t", 0.1, 1.0, 0.5), ("u", 0.9, 1.0, 0.5)], "task string, error double, honest_error double, ceiling_error double")
    assert {r["task"]: r["leaked"] for r in episodes.leak_verdicts(runs).collect()} == {"t": True, "u": False}


def test_folds_see_what_was_known(spark):
    r = random.Random(7)
    rows = [(s, DAY + dt.timedelta(days=d), dt.datetime(2026, 1, 1) + dt.timedelta(days=d + r.randint(0, 4), hours=k), k, r.random()) for s in "ab" for d in range(12) for k in range(3)]
    v = spark.createDataFrame(rows, "series string, valid date, known timestamp_ntz, revision long, value double")
    cuts = [(i, dt.datetime(2026, 1, 3 + 2 * i, 5)) for i in range(5)]
    got = {(x["fold"], x["series"], x["valid"]): x["value"] for x in bitemporal.as_of_folds(v, spark.createDataFrame(cuts, "fold int, cutoff timestamp_ntz")).collect()}
    want = {}
    for i, c in cuts:
        for s, valid, known, k, value in sorted(rows, key=lambda x: (x[2], x[3])):
            if known <= c and dt.datetime.combine(valid, dt.time()) <= c:
                want[i, s, valid] = value
    assert got == want
    plain = bitemporal.from_rows(spark.createDataFrame([("a", DAY, 1.0)], "series string, ts date, value double"))
    assert bitemporal.value_as_of(plain, "a", DAY, DAY).first()["value"] == 1.0
    null = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2), None, 0)], "series string, valid timestamp_ntz, known timestamp_ntz, value double, row_no long")
    store = bitemporal.ingest(spark.createDataFrame([], "series string, valid timestamp_ntz, known timestamp_ntz, revision long, value double"), null)
    assert store.count() == 1 and bitemporal.ingest(store, null).count() == 0


def test_quality_levels(spark):
    day = lambda i: DAY + dt.timedelta(days=i)
    rows = [("clean", day(i), 1.0) for i in range(20)]
    rows += [("twice", day(i), 1.0) for i in (*range(20), 3)] + [("differs", day(i), float(i)) for i in range(20)] + [("differs", day(3), 9.0)]
    rows += [("hole", day(i), 1.0) for i in range(20) if i not in (5, 6)] + [("broken", day(i), 1.0) for i in (0, 1, 2, 40, 41)]
    got = {r["series"]: r["status"] for r in api.quality_levels(spark.createDataFrame(rows, "series string, ts date, value double")).collect()}
    assert got == {"clean": "clean", "twice": "repaired_safe", "differs": "repaired_aggressive", "hole": "repaired_aggressive", "broken": "refused"}


def test_written_tables_are_found_again(spark, tmp_path):
    known = refs.Refs(most=2)
    names = [known.put(spark.range(i)) for i in (1, 2, 3)]
    assert known.get(names[2]).count() == 3
    with pytest.raises(KeyError):
        known.get(names[0])
    f = spark.createDataFrame([("a", "2026-01-01", 1.0, 0.5, "supported")], "series string, timestamp string, point double, q10 double, tier string")
    where = write_forecast(f, str(tmp_path))
    assert refs.read_forecast(spark, f"{tmp_path}/{where}").first()["q10"] == 0.5
    (tmp_path / "act.csv").write_text("day,sales\n2026-01-01,$5\n2026-01-02,7\n")
    assert [r["actual"] for r in refs.read_actuals(spark, f"{tmp_path}/act.csv").orderBy("ts").collect()] == [5.0, 7.0]
    (tmp_path / "cov.csv").write_text("day,seen,temp\n2026-01-01,2025-12-30,4.5\n")
    assert refs.read_covariates(spark, f"{tmp_path}/cov.csv", [("temp", "continuous")], "day", "seen").first()["temp"] == 4.5
    r = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, v long")
    assert refs.append_receipts(r, f"{tmp_path}/receipts", ["key"]) == 2 and refs.append_receipts(r, f"{tmp_path}/receipts", ["key"]) == 0
    assert {x["v"] for x in spark.read.parquet(f"{tmp_path}/receipts").collect()} == {1, 3}
    refs.export_snapshot({"receipts": r}, f"{tmp_path}/dump")
    assert spark.read.json(f"{tmp_path}/dump/receipts").count() == 3


def test_capabilities_say_what_they_do(spark):
    got = registry.capabilities(spark).collect()
    assert len(got) == len(registry.OPERATORS) + len(registry.MACROS) and all(r["summary"] for r in got)
    assert {r["claim"] for r in got if r["kind"] == "operator"} == {"descriptive", "associational", "predictive", "decision"}
