"""Sources: any Spark reader, as strings with their place in the file, then parsed leniently.

What a file looks like (suffix, delimiter, encoding) is told from its first bytes, read through Spark, so that any path
that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import comma_role, parse_number, parse_time

FORMATS = {".csv": "csv", ".tsv": "csv", ".json": "array", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".pq": "parquet", ".orc": "orc", ".xlsx": "excel"}
# Delimiters that are tried where the named columns are not split by commas, in this order: fixed values.
DELIMITERS = (";", "\t", "|")
PROBE = 65_536
# What Windows-1252 has where ISO-8859-1 has control characters.
C1 = tuple(map("".join, zip(*[(chr(b), bytes([b]).decode("cp1252")) for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)], strict=True)))


def suffix_of(path: str) -> str:
    """The suffix that tells the format; a `.gz` after it only tells the compression."""
    name = path.rstrip("/").lower().removesuffix(".gz")
    return next((s for s in FORMATS if name.endswith(s)), "")


def delimiter(header: str, columns: tuple[str, ...]) -> str:
    """The comma, unless another delimiter splits out all named columns and the comma does not."""

    def splits(sep: str) -> bool:
        return {*columns} <= {f.strip().strip('"') for f in header.split(sep)}

    return "," if splits(",") else next((d for d in DELIMITERS if splits(d)), ",")


def first_bytes(spark: SparkSession, path: str) -> bytes:
    """The first PROBE bytes of the first line of a text file or of the first file of a folder; bytes keep their value."""
    row = spark.read.option("encoding", "ISO-8859-1").option("wholetext", False).text(path).limit(1).select(F.encode(F.substring("value", 1, PROBE), "ISO-8859-1").alias("b")).first()
    return bytes(row["b"]) if row and row["b"] is not None else b""


def has_bad_bytes(spark: SparkSession, path: str) -> bool:
    """Whether any line of the file is no UTF-8."""
    raw = F.encode("value", "ISO-8859-1")
    lines = spark.read.format("csv").option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").schema("value string").load(path)
    return bool(lines.where(F.coalesce(~F.is_valid_utf8(raw.cast("string")), F.lit(False))).limit(1).count())


def read_table(spark: SparkSession, path: str, fmt: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """A table by its suffix (`.gz` after it or not) or format, with `file_row_no`: rows in order of file and place within it.

    Of a CSV file whose `columns` are named the delimiter is found in the header, and bytes that are no UTF-8 are read as
    Windows-1252. `.json` is one array of flat objects, `.jsonl` one object a line.
    """
    kind = fmt or FORMATS.get(suffix_of(path), "parquet")
    reader = spark.read
    if kind == "excel":
        raise ValueError("UNSUPPORTED_INPUT: .xlsx needs a reader that is not installed here; save the sheet as CSV")
    if kind == "csv":
        sep = "\t" if suffix_of(path) == ".tsv" else delimiter(first_bytes(spark, path).decode("utf-8-sig", "replace"), columns) if columns else ","
        reader = reader.option("header", True).option("sep", sep)
        if columns and has_bad_bytes(spark, path):
            table = reader.option("encoding", "ISO-8859-1").csv(path)
            return table.select(*[F.translate(F.col(f"`{c}`"), *C1).alias(c.translate(dict(zip(map(ord, C1[0]), C1[1], strict=True)))) for c in table.columns], F.monotonically_increasing_id().alias("file_row_no"))
    if kind == "array":
        reader = reader.option("multiLine", True)
    return reader.format("json" if kind == "array" else kind).load(path).withColumn("file_row_no", F.monotonically_increasing_id())


def inline(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Observations given as a list of objects, with `file_row_no`."""
    if not rows or not all(isinstance(r, dict) for r in rows):
        raise ValueError("INVALID_ARGUMENTS: observations must be a non-empty list of objects")
    names = list(dict.fromkeys(k for r in rows for k in r))
    cells = [tuple(None if r.get(n) is None else str(r[n]) for n in names) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(cells, ", ".join(f"`{n}` string" for n in names) + ", file_row_no long")


def wide_to_long(df: DataFrame, ts: str, targets: list[str], series: str | None = None) -> DataFrame:
    """(series, ts, value): one scan of a table with a column for each target; the series is `<series>/<target>`."""
    keys = [F.col(ts).alias("ts"), F.col(series).cast("string").alias("_s") if series else F.lit(None).cast("string").alias("_s")]
    each = df.select(*keys, *[F.col(t).cast("double").alias(t) for t in targets]).unpivot(["ts", "_s"], targets, "target", "value")
    return each.where("value is not null").select(F.concat_ws("/", "_s", "target").alias("series"), "ts", "value")


def numeric_targets(df: DataFrame, ts: str, sample: int = 50) -> list[str]:
    """The columns beside ts whose first `sample` rows are all numbers or missing: what `auto` takes as targets."""
    rest = [c for c in df.columns if c not in (ts, "file_row_no")]
    tiers = [F.bool_and(~parse_number(F.col(c))["tier"].isin("error")).alias(c) for c in rest]
    some = [F.bool_or(parse_number(F.col(c))["value"].isNotNull()).alias(f"_{c}") for c in rest]
    got = df.limit(sample).agg(*tiers, *some).first()
    return [c for c in rest if got[c] and got[f"_{c}"]]


def infer_columns(df: DataFrame, sample: int = 50) -> tuple[str, str] | None:
    """(time, value) where exactly one column is all times and exactly one other is all numbers; else none is chosen."""
    names = [c for c in df.columns if c != "file_row_no"]
    times = [F.bool_and(parse_time(F.col(c)).isNotNull()).alias(c) for c in names]
    got = df.limit(sample).agg(*times).first()
    found = [c for c in names if got[c]]
    if len(found) != 1:
        return None
    targets = numeric_targets(df, found[0], sample)
    return (found[0], targets[0]) if len(targets) == 1 else None


EVENT = """struct<event_id: string, event_type: string, entity_scope: array<string>, effective_start: string,
    effective_end: string, known_at: string, status: string, attributes: struct<claim: struct<kind: string, value: double>>,
    source: struct<type: string, reference: string>>"""


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Context events of a JSON file {events: [...]}, in the columns that `operators.context` takes."""
    raw = spark.read.option("multiLine", True).schema(f"schema_version string, events array<{EVENT}>").json(path)
    e = raw.select(F.explode("events").alias("e")).select("e.*")
    when = lambda c: parse_time(F.col(c))
    return e.select("event_id", F.col("entity_scope").alias("scope"), when("effective_start").alias("start"), when("effective_end").alias("end"), when("known_at").alias("known_at"), "status", F.col("source.reference").alias("source"), F.col("attributes.claim.kind").alias("kind"), F.col("attributes.claim.value").alias("value"))


def load_series(df: DataFrame, ts: str, value: str, series: str | None = None, max_dropped: float = 0.05) -> DataFrame:
    """(series, ts, value, tier, file_row_no) of a table of text cells; refused if too many cells do not parse."""
    role = df.agg(comma_role(F.col(value)).alias("r")).first()["r"]
    n = parse_number(F.col(value), role)
    out = df.select(F.col(series).cast("string").alias("series") if series else F.lit("default").alias("series"), parse_time(F.col(ts)).alias("ts"), n.alias("n"), "file_row_no")
    blank = F.col("ts").isNull() & (F.col("n.tier") == "missing")
    out = out.where(~blank).select("series", "ts", F.col("n.value").alias("value"), F.col("n.tier").alias("tier"), "file_row_no")
    bad, total = out.agg(F.count_if(F.col("ts").isNull() | (F.col("tier") == "error")), F.count("*")).first()
    if total and bad / total > max_dropped:
        raise ValueError(f"UNPARSEABLE_ROWS: {bad} of {total}")
    return out.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
