"""Tables that a session has resolved already, and tables that runs have written: found again by name."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import parse_number, parse_time
from .readers import infer_columns, read_table

MOST_REFS = 128


class Refs:
    """References to frames of one session; the one used longest ago goes when there are too many."""

    def __init__(self, most: int = MOST_REFS):
        self.most, self.known, self.made = most, OrderedDict(), 0

    def put(self, df: DataFrame) -> str:
        self.made += 1
        name = f"data_{self.made}"
        self.known[name] = df
        while len(self.known) > self.most:
            self.known.popitem(last=False)
        return name

    def get(self, name: str) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"UNKNOWN_DATA_REF: {name}")
        self.known.move_to_end(name)
        return self.known[name]


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a published forecast, numbers as doubles."""
    raw = spark.read.option("header", True).csv(f"{path}/forecast")
    texts = ("series", "timestamp", "tier", "model")
    return raw.select(*[F.col(c) if c in texts else F.col(c).cast("double") for c in raw.columns])


def read_actuals(spark: SparkSession, path: str, ts: str | None = None, value: str | None = None, series: str | None = None, known_at: str | None = None) -> DataFrame:
    """(series, ts, actual, known_at) of a table whose columns are named, or told where only one choice is possible."""
    raw = read_table(spark, path)
    if ts is None or value is None:
        found = infer_columns(raw)
        if found is None:
            raise ValueError("AMBIGUOUS_COLUMNS: name the time and the value column")
        ts, value = found
    when = lambda c: parse_time(F.col(c)) if c else F.lit(None).cast("timestamp_ntz")
    return raw.select(F.col(series).cast("string").alias("series") if series else F.lit("default").alias("series"), when(ts).alias("ts"), parse_number(F.col(value))["value"].alias("actual"), when(known_at).alias("known_at"))


def read_covariates(spark: SparkSession, path: str, specs: list[tuple[str, str]], ts: str, known_at: str, series: str | None = None) -> DataFrame:
    """(series, valid_at, known_at, covariates...) of a table."""
    raw = read_table(spark, path)
    cells = [parse_number(F.col(n))["value"].alias(n) for n, _ in specs]
    return raw.select(F.col(series).cast("string").alias("series") if series else F.lit("default").alias("series"), parse_time(F.col(ts)).alias("valid_at"), parse_time(F.col(known_at)).alias("known_at"), *cells)


def append_receipts(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key is not stored yet, once each; how many there were. A receipt is never changed."""
    from ..operators.ledger import first_seen

    spark = df.sparkSession
    try:
        stored = spark.read.schema(df.schema).parquet(path)
        stored.limit(1).count()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = df.where("false")
    fresh = first_seen(df, stored, keys).select(df.columns)
    rows = fresh.count()
    if rows:
        fresh.write.mode("append").parquet(path)
    return rows


def export_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Every table of a ledger as JSON lines under path/<name>."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")
