"""Worlds with a known right answer, to grade what a policy does in them, and metrics of published benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What should be done in each kind of world: fixed values.
EXPECTED = {"forecastable": "act", "abstention_trap": "abstain", "leakage_trap": "act", "regime_break_trap": "warn_or_abstain"}
START = "2026-01-01"


def noise(seed: int, i):
    """Numbers between -1 and 1 that depend on the seed and the place only."""
    return F.pmod(F.xxhash64(F.lit(seed), i.cast("long")), F.lit(2_000_001)) / 1e6 - 1


def worlds(spark: SparkSession, seeds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(episode, kind, ts, known, value, hidden): rows of every kind of world for every seed.

    hidden rows are the future, which a policy must not see; in the leakage trap they and a late revision lie in the same
    table, with the time from which they are known.
    """
    out = None
    for seed in seeds:
        i = spark.range(47).withColumnRenamed("id", "i")
        day = lambda c: F.date_add(F.lit(START).cast("date"), c.cast("int"))
        x = F.col("i")
        shapes = {
            "forecastable": (47, 40, 100 + x * 1.2 + noise(seed, x) * 4),
            "abstention_trap": (11, 4, 100 + noise(seed, x) * 5),
            "leakage_trap": (47, 40, 200 + x * 0.8 + noise(seed, x) * 3),
            "regime_break_trap": (41, 34, F.when(x < 30, 150.0).otherwise(190.0) + noise(seed, x) * 2),
        }
        for kind, (n, cutoff, value) in shapes.items():
            part = i.where(x < n).select(F.lit(f"{kind}_{seed}").alias("episode"), F.lit(kind).alias("kind"), day(x).alias("ts"), day(x).alias("known"), value.cast("double").alias("value"), (x >= cutoff).alias("hidden"))
            if kind == "leakage_trap":
                late = part.where(F.col("ts") == F.date_add(F.lit(START).cast("date"), cutoff - 5)).withColumn("value", F.col("value") + 25).withColumn("known", day(F.lit(cutoff + 1)))
                part = part.unionByName(late)
            out = part if out is None else out.unionByName(part)
    return out


def visible(rows: DataFrame) -> DataFrame:
    """What an honest policy sees: the latest value of each day known by the last day that is not hidden."""
    cutoff = rows.where("not hidden").groupBy("episode").agg(F.max("ts").alias("cutoff"))
    seen = rows.join(cutoff, "episode").where((F.col("known") <= F.col("cutoff")) & (F.col("ts") <= F.col("cutoff")))
    return seen.groupBy("episode", "kind", "ts").agg(F.max_by("value", "known").alias("value"))


def graded(decisions: DataFrame) -> DataFrame:
    """Of (episode, kind, action: act, warn or abstain, saw_hidden): (episode, passed, leaked)."""
    want = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])[F.col("kind")]
    ok = F.when(want == "act", F.col("action").isin("act", "warn")).when(want == "abstain", F.col("action") == "abstain").otherwise(F.col("action").isin("warn", "abstain"))
    return decisions.select("episode", (ok & ~F.col("saw_hidden")).alias("passed"), F.col("saw_hidden").alias("leaked"))


def interval_f1(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """(series, precision, recall, f1) by rows: of flagged (series, idx) against true (series, idx)."""
    f, t = flags.select("series", "idx").distinct().withColumn("f", F.lit(1)), truth.select("series", "idx").distinct().withColumn("t", F.lit(1))
    a = f.join(t, ["series", "idx"], "full").groupBy("series").agg(F.count("f").alias("nf"), F.count("t").alias("nt"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "nf"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "nt"), F.lit(0.0))
    return a.select("series", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def merged_intervals(rows: DataFrame, gap: int = 1) -> DataFrame:
    """(series, first, last): flagged rows (series, idx) no more than `gap` apart, as intervals."""
    w = Window.partitionBy("series").orderBy("idx")
    new = F.coalesce((F.col("idx") - F.lag("idx").over(w) > gap).cast("int"), F.lit(1))
    d = rows.select("series", "idx").distinct().withColumn("_n", new).withColumn("_g", F.sum("_n").over(w))
    return d.groupBy("series", "_g").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).drop("_g")


def leak_verdicts(runs: DataFrame, advantage: float = 0.5) -> DataFrame:
    """Of (task, error, honest_error, ceiling_error): (task, advantage, leaked).

    A run that closes more than the given share of the gap between the honest error and none, and beats the best that could
    be reached without leaks, has seen the future.
    """
    share = F.try_divide(F.col("honest_error") - F.col("error"), F.col("honest_error"))
    return runs.select("task", share.alias("advantage"), F.coalesce((share > advantage) & (F.col("error") < F.col("ceiling_error")), F.lit(False)).alias("leaked"))
