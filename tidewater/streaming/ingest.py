"""Streams into the bitemporal store, and windowed counts with late data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bitemporal import ingest


def hourly(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and type; rows later than `late` behind the newest are left out by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def ingest_stream(batches: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of (series, valid, known, value, row_no) to a Parquet store; a batch that is replayed adds nothing,
    because its rows are then already stored."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        schema = "series string, valid timestamp_ntz, known timestamp_ntz, revision long, value double"
        low, high = batch.agg(F.min("valid"), F.max("valid")).first()
        try:
            # Only vintages of the batch's valid times matter; the filter prunes the rest of the store at the scan.
            old = spark.read.schema(schema).parquet(store).where(F.col("valid").between(F.lit(low), F.lit(high)))
        except AnalysisException:  # the store does not exist before the first batch
            old = spark.createDataFrame([], schema)
        ingest(old, batch).write.mode("append").parquet(store)

    return batches.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
