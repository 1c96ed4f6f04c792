"""Statistics as column expressions: aggregates over groups, and folds over arrays of values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scale of a median absolute deviation for normal data: a fixed value.
MAD_SCALE = 1.4826
TINY = 1e-12


def median(x: str | Column) -> Column:
    return F.percentile(F.col(x) if isinstance(x, str) else x, F.lit(0.5))


def with_robust_scale(df: DataFrame, value: str = "value", keys: tuple[str, ...] = ("series",), fallback: bool = True) -> DataFrame:
    """One row for each key: med, mad and scale; with a fallback to the sample deviation where the MAD vanishes."""
    med = df.groupBy(*keys).agg(median(value).alias("med"))
    dev = df.join(med, list(keys)).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    out = dev.groupBy(*keys).agg(F.first("med").alias("med"), median("dev").alias("mad"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    spread = F.when(F.col("mad") > TINY, F.col("mad") * MAD_SCALE)
    return out.select(*keys, "med", "mad", (spread.otherwise(F.col("sd")) if fallback else F.greatest(F.col("mad") * MAD_SCALE, F.lit(TINY))).alias("scale"))


def wape(actual: str | Column, predicted: str | Column) -> Column:
    a, p = (F.col(x) if isinstance(x, str) else x for x in (actual, predicted))
    total = F.sum(F.abs(a))
    return F.when(total > TINY, F.sum(F.abs(a - p)) / total)


def pinball(actual: Column, predicted: Column, level: Column) -> Column:
    d = actual - predicted
    return F.when(d >= 0, level * d).otherwise((level - 1) * d)


def conformal_rank(n: Column, level: float) -> Column:
    """The one-based rank of the order statistic that a conformal quantile takes."""
    if level >= 0.5:
        return F.least(F.ceil((n + 1) * F.lit(level)), n)
    return F.greatest(F.floor((n + 1) * F.lit(level)), F.lit(1))


def conformal_quantile(values: Column, level: float) -> Column:
    """Of an array of values."""
    return F.get(F.array_sort(values), (conformal_rank(F.size(values), level) - 1).cast("int"))


def nearest_rank(values: Column, level: float) -> Column:
    """The order statistic ceil(level * n) of an array."""
    return F.get(F.array_sort(values), (F.greatest(F.ceil(F.lit(level) * F.size(values)), F.lit(1)) - 1).cast("int"))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson's r; null for fewer than three pairs or a vanishing variance."""
    n = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
    enough = (n >= 3) & (F.var_pop(x) * n > TINY) & (F.var_pop(y) * n > TINY)
    return F.when(enough, F.corr(x, y))


def wilson_upper(successes: Column, n: Column, z: float = 1.96) -> Column:
    p = successes / n
    root = F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    return F.least((p + F.lit(z * z) / (2 * n) + z * root) / (1 + F.lit(z * z) / n), F.lit(1.0))


def binomial_two_sided(wins: int, losses: int) -> float:
    """The exact two-sided sign test, also McNemar's on discordant pairs."""
    n, k = wins + losses, min(wins, losses)
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def isotonic(values: Column) -> Column:
    """The nearest non-decreasing array in least squares, by pooling neighbours that are out of order.

    A fold over the values keeps a stack of blocks (mean, count); a value that is less than the last block's mean is pooled
    with it, and on, as long as the means fall.
    """
    none = F.array().cast("array<struct<m:double,c:int>>")

    def pool(stack: Column, v: Column) -> Column:
        # How many blocks from the end are pooled: while the mean of what is pooled is under the block before.
        one = F.struct(v.cast("double").alias("m"), F.lit(1).alias("c"), F.lit(0).alias("k"), F.lit(True).alias("on"))

        def take(s: Column, b: Column) -> Column:
            more = s["on"] & (b["m"] > s["m"])
            both = F.struct(((s["m"] * s["c"] + b["m"] * b["c"]) / (s["c"] + b["c"])).alias("m"), (s["c"] + b["c"]).alias("c"), (s["k"] + 1).alias("k"), F.lit(True).alias("on"))
            return F.when(more, both).otherwise(F.struct(s["m"].alias("m"), s["c"].alias("c"), s["k"].alias("k"), F.lit(False).alias("on")))

        done = F.aggregate(F.reverse(stack), one, take)
        return F.get(F.transform(F.array(done), lambda x: F.concat(F.slice(stack, F.lit(1), F.size(stack) - x["k"]), F.array(F.struct(x["m"].alias("m"), x["c"].alias("c"))))), 0)

    blocks = F.aggregate(values, none, pool)
    return F.flatten(F.transform(blocks, lambda b: F.array_repeat(b["m"], b["c"])))
