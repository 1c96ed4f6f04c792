"""The long frame that operators share: (series, ts, value), and `idx`, the dense position of a row in its series."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_series(*order: str) -> WindowSpec:
    return Window.partitionBy("series").orderBy(*(order or ("ts",)))


def indexed(df: DataFrame) -> DataFrame:
    """Adds `idx` (0, 1, ...) by time within each series; ties in time go by value."""
    return df.withColumn("idx", (F.row_number().over(by_series("ts", "value")) - 1).cast("long"))


def observations(df: DataFrame, ts: str | Column, value: str | Column, series: str | Column | None = None) -> DataFrame:
    """Name the columns of any table; rows without a time or a finite value are left out."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    name = F.lit("default") if series is None else col(series).cast("string")
    out = df.select(name.alias("series"), col(ts).alias("ts"), col(value).cast("double").alias("value"))
    return out.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))


def histories(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each series (and further keys) with its values in order of idx, for ordered folds."""
    pair = F.struct("idx", "value")
    values = F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["value"])
    return df.groupBy("series", *keys).agg(values.alias("h"))


def materialised(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder (spark.checkpoint.dir where it is set)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidewater-"))
    return df.checkpoint(eager=True)
