"""Queries and operators whose inputs are larger than those of the test tables."""

import datetime as dt
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.operators import context
from tidewater.plans.catalogue import QUERIES, SQL


def sums(spark, name, path):
    """Rows by all but event ids, with how many there are and the sum of the ids."""
    df = QUERIES[name](spark, str(path))
    rest = [c for c in df.columns if c != "event_id"]
    return sorted(map(repr, map(tuple, df.groupBy(*rest).agg(F.count("*"), F.sum("event_id")).select(*sorted(rest), "count(1)", "sum(event_id)").collect())))


def wanted(name, path):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    rest = sorted(c[0] for c in con.execute(SQL[name]).description if c[0] != "event_id")
    by = ", ".join(rest)
    return sorted(map(repr, con.execute(f"select {by}, count(*), sum(event_id)::bigint from ({SQL[name]}) group by {by}").fetchall()))


def test_eligibility_of_many_rows_of_series(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [("one", ["a"], "confirmed", "desk"), ("all", ["*"], "confirmed", "desk"), ("off", ["a", "b"], "cancelled", "desk"), ("none", [], "confirmed", None)]
    ev = spark.createDataFrame([(i, s, at, at, at, st, so) for i, s, st, so in rows], "event_id string, scope array<string>, start timestamp_ntz, end timestamp_ntz, known_at timestamp_ntz, status string, source string")
    few = spark.createDataFrame([("a",), ("b",), ("c",)], "series string")
    many = spark.range(150_000).select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("series"))
    got = {n: sorted(map(tuple, context.eligibility(ev, s).collect())) for n, s in (("few", few), ("many", many))}
    assert got["many"] == got["few"] and len(got["many"]) == 12
    assert ("c", "one", False, "scope does not include this series") in got["many"] and ("c", "all", True, None) in got["many"]


def test_eligibility_query_as_its_sql_beyond_100_000_events(spark, tmp_path):
    types = F.element_at(F.array(*map(F.lit, ("view", "click", "buy"))), (F.col("id") % 3 + 1).cast("int"))
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)")
    made = spark.range(120_000).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 50).alias("user_id"), types.alias("event_type"), F.lit(1.0).alias("value"))
    made.write.parquet(f"{tmp_path}/events.parquet")
    assert sums(spark, "event_eligibility", tmp_path) == wanted("event_eligibility", tmp_path)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_conflicts_of_windows_of_all_lengths(spark, kind):
    r, at = random.Random(5), dt.datetime(2026, 3, 27)
    unit = 86_400_000_000 if kind == "date" else 1
    spans = [(r.randrange(0, 4 * 86_400_000_000), r.choice([-90_000_000_000, -1, 0, 1, 2, 3, 1_000, 60_000_000, 5_000_000_000, 300_000_000_000])) for _ in range(150)]
    rows = [(i, r.choice("ab"), at + dt.timedelta(microseconds=t // unit * unit), at + dt.timedelta(microseconds=(t + n) // unit * unit), float(r.randrange(3))) for i, (t, n) in enumerate(spans)]
    rows += [(i + 500, s, a, b + dt.timedelta(hours=24 * (i % 2)), v + 1) for i, s, a, b, v in rows[::5]]
    rows += [(900, None, at, at, 1.0), (901, "a", None, at, 1.0), (902, "a", at, None, 1.0), (903, "a", at, at, None)]
    want = sorted((x[1], x[0], y[0]) for x in rows for y in rows if None not in x + y and x[1] == y[1] and x[0] < y[0] and x[2] <= y[3] and y[2] <= x[3] and x[4] != y[4])
    ev = spark.createDataFrame(rows, "event_id long, series string, start timestamp_ntz, end timestamp_ntz, value double")
    ev = ev.select("event_id", "series", F.col("start").cast(kind).alias("start"), F.col("end").cast(kind).alias("end"), "value")
    assert sorted(map(tuple, context.windows_conflict(ev).collect())) == want and len(want) > 100


def test_conflicts_of_a_crowded_day_take_seconds(spark):
    # All pairs of the day are 3.2 billion.
    n = 80_000
    at = F.timestamp_add("SECOND", F.col("id"), F.lit("2026-01-01").cast("timestamp_ntz"))
    ev = spark.range(n).select(F.col("id").alias("event_id"), F.lit("a").alias("series"), at.alias("start"), F.timestamp_add("SECOND", F.lit(1), at).alias("end"), (F.col("id") % 2).cast("double").alias("value"))
    began = time.time()
    assert context.windows_conflict(ev).count() == n - 1
    assert time.time() - began < 30
