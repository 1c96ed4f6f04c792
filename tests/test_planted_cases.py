"""Planted cases, each on a few rows."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewater import api
from tidewater.frames import histories, indexed
from tidewater.functions.parsing import parse_number
from tidewater.functions.stats import binomial_two_sided, isotonic
from tidewater.operators import bitemporal, descriptive, evaluate, models, quality, windows
from tidewater.sources.readers import load_series, read_table
from tidewater.sources.sinks import content_id, write_artifact

DAY = dt.date(2026, 1, 1)


def frame(spark, values, name="a"):
    return spark.createDataFrame([(name, DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "series string, ts date, value double")


def test_changepoint_finds_a_level_shift(spark):
    random.seed(1)
    df = indexed(frame(spark, [10 + random.random() for _ in range(40)] + [30 + random.random() for _ in range(40)]))
    r = descriptive.changepoint(df).first()
    assert r["split"] == 40 and r["detected"]
    assert descriptive.regime(df, descriptive.changepoint(df)).first()["regime"] == "regime_shift"


def test_flat_series_has_no_change_and_no_anomaly(spark):
    df = indexed(frame(spark, [5.0] * 30))
    assert not descriptive.changepoint(df).first()["detected"]
    assert descriptive.anomaly_score(df).where("anomalous").count() == 0


def test_spike_is_an_anomaly(spark):
    values = [i % 7 + (i * 37 % 11) / 10 for i in range(60)]
    values[33] = 500.0
    assert [r["idx"] for r in descriptive.anomaly_score(indexed(frame(spark, values)), 7).where("anomalous").collect()] == [33]


def test_linear_series_picks_a_trend_and_zero_spread(spark):
    rows = evaluate.forecast(indexed(frame(spark, [100 + 3 * i for i in range(36)])), 7, 7).orderBy("step").collect()
    assert [round(r["point"], 6) for r in rows] == [100 + 3 * i for i in range(36, 43)]
    assert all(abs(r["q95"] - r["q05"]) < 1e-6 for r in rows)


def test_models_need_history(spark):
    h = histories(indexed(frame(spark, [1.0])))
    got = h.select(*[m(F.col("h"), 2, 7).alias(k) for k, m in models.MODELS.items()]).first()
    assert got["last_value"] == [1.0, 1.0] and got["seasonal_naive"] is None and got["drift"] is None and got["ets"] is None


def test_ets_against_a_plain_loop(spark):
    random.seed(3)
    h, s = [50 + 10 * (i % 4) + random.random() for i in range(30)], 4
    best = None
    for a, b, g in itertools.product((0.2, 0.5, 0.8), (0.05, 0.2), (0.05, 0.3)):
        level = sum(h[:s]) / s
        trend, phase, sse = (sum(h[s : 2 * s]) / s - level) / s, [x - level for x in h[:s]], 0.0
        for i in range(s, len(h)):
            e = h[i] - (level + trend + phase[i % s])
            old, sse = level, sse + e * e
            level = a * (h[i] - phase[i % s]) + (1 - a) * (level + trend)
            trend = b * (level - old) + (1 - b) * trend
            phase[i % s] = g * (h[i] - level) + (1 - g) * phase[i % s]
        if best is None or sse < best[0]:
            best = sse, [level + trend * k + phase[(len(h) + k - 1) % s] for k in (1, 2, 3)]
    got = histories(indexed(frame(spark, h))).select(models.ets(F.col("h"), 3, s).alias("p")).first()["p"]
    assert got == pytest.approx(best[1])


def test_snapshot_never_sees_later_knowledge(spark):
    v = spark.createDataFrame([("a", DAY, "2026-01-02", 1, 1.0), ("a", DAY, "2026-01-05", 2, 9.0)], "series string, valid date, k string, revision long, value double").withColumn("known", F.col("k").cast("timestamp_ntz"))
    assert bitemporal.snapshot(v, "2026-01-03").first()["value"] == 1.0
    assert bitemporal.snapshot(v, "2026-01-06").first()["value"] == 9.0
    assert bitemporal.snapshot(v, "2026-01-01").count() == 0
    again = v.withColumn("row_no", F.lit(1).cast("long"))
    assert bitemporal.ingest(v, again).count() == 0


def test_filled_gap_lies_on_the_line(spark):
    df = frame(spark, [0, 1, 2, 3]).where("value not in (1, 2)")
    assert sorted(r["value"] for r in quality.fill_linear(df).collect()) == [0, 1, 2, 3]


def test_empty_frames(spark):
    e = indexed(frame(spark, [1.0])).where("false")
    for f in (lambda d: windows.resample(d, 2), windows.difference, windows.split_scan, descriptive.profile, descriptive.changepoint, lambda d: evaluate.backtest(d, 2, 2), descriptive.correlations):
        assert f(e).count() == 0


def test_isotonic_and_sign_test(spark):
    got = spark.createDataFrame([([3.0, 1.0, 2.0, 5.0],)], "v array<double>").select(isotonic(F.col("v")).alias("x")).first()["x"]
    assert got == pytest.approx([2.0, 2.0, 2.0, 5.0])
    assert binomial_two_sided(5, 5) == 1.0 and binomial_two_sided(10, 0) == pytest.approx(2 / 1024)


def test_number_with_known_comma(spark):
    got = spark.createDataFrame([("1,234",)], "c string").select(parse_number(F.col("c"), "decimal").alias("n")).first()["n"]
    assert (got["value"], got["tier"]) == (1.234, "normalised")


def test_files_and_artifacts(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("when,amount,notes\n2026-01-01,$100,\n2026/01/02,\"1,234.5\",\n,,\n2026-01-03,12,\n")
    got = load_series(read_table(spark, str(p)), "when", "amount").orderBy("ts").collect()
    assert [r["value"] for r in got] == [100.0, 1234.5, 12.0]
    df = frame(spark, [1, 2, 3])
    assert content_id(df) == content_id(df.repartition(3)) != content_id(frame(spark, [1, 2, 4]))
    assert spark.read.json(f"{tmp_path}/{write_artifact(df, str(tmp_path))}").count() == 3


def test_api_answers(spark):
    df = frame(spark, [10 + (i % 7) + i / 10 for i in range(60)])
    assert api.inspect(df).first()["step_seconds"] == 86400
    assert api.describe(df).first()["n"] == 60
    assert api.decide(df, 3, 7, 0.0, {"go": (2.0, 0.0), "stay": (1.0, 1.0)}).count() == 2


def test_stream_is_ingested_once(spark, tmp_path):
    from tidewater.streaming.ingest import ingest_stream

    rows = spark.createDataFrame([("a", "2026-01-01", "2026-01-02", 1.0, 1)], "series string, v string, k string, value double, row_no long")
    rows = rows.select("series", F.col("v").cast("timestamp_ntz").alias("valid"), F.col("k").cast("timestamp_ntz").alias("known"), "value", "row_no")
    for i in range(2):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        ingest_stream(s, f"{tmp_path}/store", f"{tmp_path}/ck{i}").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/store").count() == 1
