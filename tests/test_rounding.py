"""Rounding of results as their SQL rounds."""

import datetime

import duckdb

from tidewater.plans.catalogue import QUERIES, SQL, rounded


def test_ties_as_in_sql(spark):
    values = [4.1734955, 4.1280375, -4.1734955, 2.8854365000000004, 3.0623484999999997, 0.0000005, -0.0, 123456789.1234565, 1e300, None]
    got = [r["x"] for r in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")).orderBy("i").collect()]
    con = duckdb.connect()
    assert got == [con.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]


def test_compare_forecasts_on_ties(spark, tmp_path):
    at = datetime.datetime(1997, 12, 19)
    rows = [(k, "1-URGENT", at, t) for k, t in enumerate([194285.0, 417349.55, 412803.75, 288543.65, 306234.85])]
    path = str(tmp_path / "orders.parquet")
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(path)
    df = QUERIES["compare_forecasts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{path}/*.parquet'")
    ran = con.execute(SQL["compare_forecasts"])
    cols = [x[0] for x in ran.description]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(ran.fetchall())
