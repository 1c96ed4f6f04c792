"""Values with the time they became known: replay any past moment without later knowledge.

A vintage table has (series, valid, known, revision, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(v: DataFrame, as_of) -> DataFrame:
    """What was known at `as_of`: for every valid time the latest vintage. One aggregation, no join."""
    at = F.struct("known", "revision")
    seen = v.where(F.col("known") <= F.lit(as_of))
    return seen.groupBy("series", "valid").agg(F.max_by("value", at).alias("value"), F.max("known").alias("known"))


def join_as_of(grid: DataFrame, v: DataFrame, as_of) -> DataFrame:
    """The grid (series, valid) with what was known of it; null where nothing was."""
    return grid.join(snapshot(v, as_of), ["series", "valid"], "left")


def as_of_folds(v: DataFrame, folds: DataFrame) -> DataFrame:
    """For each (fold, cutoff) the history known at its cutoff, so that no fold sees later revisions.

    A vintage is the answer from the time it is known, and its valid time is past, until the next is known. So each vintage
    goes to the folds whose cutoffs lie in that interval, and nothing is multiplied but the answers. Folds are few and
    travel as one array.
    """
    w = Window.partitionBy("series", "valid").orderBy("known", "revision")
    cutoffs = folds.agg(F.collect_list(F.struct("fold", "cutoff")).alias("_f"))
    d = v.withColumn("_next", F.lead("known").over(w)).crossJoin(F.broadcast(cutoffs))
    inside = lambda f: (f["cutoff"] >= F.col("known")) & (f["cutoff"] >= F.col("valid")) & (F.col("_next").isNull() | (f["cutoff"] < F.col("_next")))
    return d.select(F.explode(F.filter("_f", inside)["fold"]).alias("fold"), "series", "valid", "value")


def value_as_of(v: DataFrame, series: str, valid, as_of) -> DataFrame:
    """At most one row: what was known of one valid time; the predicates reach the scan."""
    return snapshot(v.where((F.col("series") == series) & (F.col("valid") == F.lit(valid))), as_of)


def from_rows(df: DataFrame) -> DataFrame:
    """Plain rows (series, ts, value) as a vintage table: each is known from its own time on. Duplicates are refused."""
    if df.groupBy("series", "ts").count().where("count > 1").limit(1).count():
        raise ValueError("DUPLICATE_TIMESTAMP: a series has two rows at one time")
    return df.select("series", F.col("ts").alias("valid"), F.col("ts").alias("known"), F.lit(1).cast("long").alias("revision"), "value")


def ingest(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a batch (series, valid, known, value, row_no) to append, with their revisions.

    A row is new unless its valid time, known time and value are stored; of equal rows of a batch the first counts.
    """
    keys = ["series", "valid", "known", "value"]
    known = store.select(*keys).withColumnRenamed("value", "_v")
    fresh = batch.groupBy(*keys).agg(F.min("row_no").alias("row_no"))
    # A value that is null is stored like any other, so that replays find it.
    same = [fresh[k] == known[k] for k in keys[:-1]] + [fresh["value"].eqNullSafe(known["_v"])]
    fresh = fresh.join(known, same, "left_anti")
    last = store.groupBy("series", "valid").agg(F.max("revision").alias("last"))
    order = Window.partitionBy("series", "valid").orderBy("known", "row_no")
    out = fresh.withColumn("r", F.row_number().over(order)).join(last, ["series", "valid"], "left")
    return out.select("series", "valid", "known", (F.coalesce("last", F.lit(0)) + F.col("r")).cast("long").alias("revision"), "value")


def listing(v: DataFrame) -> DataFrame:
    """Per series: vintages, distinct valid times, revised ones, and the span of knowledge."""
    return v.groupBy("series").agg(
        F.count("*").alias("n"),
        F.count_distinct("valid").alias("n_valid"),
        F.sum(F.when(F.col("revision") > 1, 1).otherwise(0)).alias("n_revisions"),
        F.min("known").alias("first_known"),
        F.max("known").alias("last_known"),
    )


def active_events(grid: DataFrame, events: DataFrame) -> DataFrame:
    """The grid (series, ts) with `flag`: whether an event known by its start covers the time.

    events: (event_id, scope, start, past, known_at), scope a series or `*`. Intervals meet on the days they cover, so
    the join is on equal keys and grows with their days, not with the product of the sides.
    """
    days = events.where("known_at <= start").withColumn("day", F.explode(F.sequence(F.to_date("start"), F.to_date("past"))))
    of_day = days.groupBy("scope", "day").agg(F.collect_list(F.struct("start", "past")).alias("spans"))
    g = grid.withColumn("day", F.to_date("ts"))
    own = of_day.select(F.col("scope").alias("series"), "day", F.col("spans").alias("own"))
    every = of_day.where("scope = '*'").select("day", F.col("spans").alias("every"))
    hit = lambda c: F.coalesce(F.exists(F.col(c), lambda s: (s["start"] <= F.col("ts")) & (F.col("ts") <= s["past"])), F.lit(False))
    return g.join(own, ["series", "day"], "left").join(every, "day", "left").withColumn("flag", hit("own") | hit("every")).drop("own", "every", "day")
