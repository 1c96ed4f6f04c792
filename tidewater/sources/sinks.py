"""Sinks: Parquet tables by series, and one JSON artifact with a content id."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "append", by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def content_id(df: DataFrame) -> str:
    """An id of the rows that depends neither on their order nor on their partitions."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in (1, 9, 17, 25)]
    got = df.agg(F.count("*").alias("n"), *parts).select(F.sha2(F.concat_ws("/", "*"), 256).alias("id")).first()
    return got["id"][:16]


def write_artifact(df: DataFrame, path: str) -> str:
    """JSON lines under path/<content id>; equal rows land in the same place, and what is there already stays."""
    name = content_id(df)
    df.write.mode("ignore").json(f"{path}/{name}")
    return name


def canonical_json(value) -> str:
    """One spelling of a JSON value: sorted keys, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str, ensure_ascii=False, allow_nan=False)


def value_id(kind: str, value, length: int = 16) -> str:
    """`<kind>_<hex>` of a value's canonical JSON."""
    return f"{kind}_{hashlib.sha256(f'{kind}{chr(0)}{canonical_json(value)}'.encode()).hexdigest()[:length]}"


def forecast_columns(df: DataFrame) -> DataFrame:
    """Forecast rows in the order that published files have: series, timestamp, point, q10, q50, q90, other quantiles, tier."""
    first = [c for c in ("series", "timestamp", "point", "q10", "q50", "q90") if c in df.columns]
    levels = sorted((c for c in df.columns if re.fullmatch(r"q\d+", c) and c not in first), key=lambda c: int(c[1:]))
    last = [c for c in ("point_bias_correction", "tier") if c in df.columns]
    return df.select(*first, *levels, *last)


def write_forecast(df: DataFrame, path: str, evidence: list[dict] | None = None) -> str:
    """An artifact folder that is written once: path/<id>/forecast as CSV, and evidence as JSON lines beside it."""
    rows = forecast_columns(df)
    name = content_id(rows)
    rows.write.mode("ignore").option("header", True).csv(f"{path}/{name}/forecast")
    lines = [(canonical_json(e),) for e in evidence or []]
    if lines:
        df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("ignore").text(f"{path}/{name}/evidence")
    return name


# What is taken out of public text, and what stands in its place: fixed values.
REDACTIONS = (
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"(?i)\b(api[_-]?key|access[_-]?token|token|secret|password)\s*[:=]\s*[^\s,;]+", "$1=[REDACTED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    (r"(?i)https?://[^\s]+", "[URL]"),
    (r"(?<![A-Za-z0-9])/(?:[^\s,;]+/)*[^\s,;]*", "[PATH]"),
    (r"\b[A-Za-z]:\\(?:[^\s,;]+\\)*[^\s,;]*", "[PATH]"),
    (r"\b(?:[A-Fa-f0-9]{32,}|[A-Za-z0-9+/]{40,}={0,2})\b", "[TOKEN]"),
)


def redacted(text: Column, most: int = 500) -> Column:
    """Text fit to show: spaces folded, secrets and addresses replaced, cut at `most` characters; null where nothing is left."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    for pattern, put in REDACTIONS:
        out = F.regexp_replace(out, pattern, put)
    return F.nullif(F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 3), F.lit("..."))).otherwise(out), F.lit(""))
