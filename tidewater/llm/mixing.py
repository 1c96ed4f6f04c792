"""Mixing sources to target weights by the cube method.

Every source gets a target number of words; a document of it is taken floor(r) times, r being target / size of the
source, and once more with the inclusion probability r - floor(r). The flight phase moves the probabilities of three
documents at a time through the null space of two balancing constraints, the words and the number of documents of the
source, until one of the three is 0 or 1; it leaves at most two documents of a block undecided. Blocks of about `block`
documents are flown apart, so a source of any size spreads over as many tasks as it needs, and what the blocks leave is
flown again until one block of a source is left. That one holds back LANDING documents of all lengths, and the landing
phase decides them and the last undecided ones together, by the smallest error of all ways to do so.

All choices follow hashes of the ids and a fixed seed: reruns agree. Null sources form a source of their own; null and
empty texts have size 0 and take no words. Rows equal in id, text and source are one unit, taken equally often each, which
balances as so many documents. A table without rows gives none. Texts of any length count whole; ties go by hash, then id.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 2000
LANDING = 12
WORD = r"[^\x20\x09-\x0D]+"
NEAR = 1e-9


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Of (source, source_size, docs), one row a source: the same with `target`.

    Sources in code point order, null last, weigh as given, repeating. With every source capped at `most` times its
    size and the excess shared again by weight, the level per weight is the largest of those that arise by filling the
    sources in the order in which they reach their caps.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    level = F.max("level").over(everything)
    return w.withColumn("target", F.least("cap", level * F.col("w"))).select("source", "source_size", "docs", "target")


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, count: np.ndarray | None = None) -> np.ndarray:
    """Probabilities moved until at most two lie strictly between 0 and 1; the totals of size and of count stay as they were.

    count is how many documents each stands for, 1 by default.
    """
    n = np.ones(len(p)) if count is None else count
    p, draws = p.copy(), iter(())
    waiting, active = iter(range(len(p))), []
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            if NEAR < p[i] < 1 - NEAR:
                active.append(i)
        if len(active) < 2 or len(active) == 2 and size[active[0]] * n[active[1]] != size[active[1]] * n[active[0]]:
            return p
        # The null space of the two constraints is the cross product of their rows; where they are parallel, that of one.
        a, b = active[:2]
        u = (float(n[b]), -float(n[a]), 0.0)[: len(active)]
        if len(active) == 3:
            c = active[2]
            cross = (float(size[b] * n[c] - size[c] * n[b]), float(size[c] * n[a] - size[a] * n[c]), float(size[a] * n[b] - size[b] * n[a]))
            u = cross if any(cross) else u
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(active, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(active, u, strict=True) if d)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(1024).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for i, d in zip(active, u, strict=True):
            p[i] += step * d
            if p[i] <= NEAR:
                p[i] = 0.0
            elif p[i] >= 1 - NEAR:
                p[i] = 1.0
        active = [i for i in active if 0 < p[i] < 1]


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The last undecided documents, LANDING + 2 at most, set to 0 or 1 by trying every way to do it.

    The way with the smallest error in words, and a twentieth of a mean document's for each document, is taken.
    """
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
    wrong = np.abs(ways @ size[left] - size[left] @ p[left]) + 0.05 * max(1.0, size.mean()) * np.abs(ways.sum(axis=1) - p[left].sum())
    p = p.copy()
    p[left] = ways[int(wrong.argmin())]
    return p


def fly(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of one source; the last block of a source holds back some documents of all lengths for the landing."""
    frame = frame.sort_values(["weight", "o", "id", "th"], kind="stable", na_position="first").reset_index(drop=True)
    first = frame.iloc[0]
    rng = np.random.default_rng([zlib.crc32(str(first["source"]).encode()), int(first["blocks"]), int(first["b"])])
    size, p = frame["weight"].to_numpy(dtype=float), frame["p"].to_numpy(dtype=float)
    last = first["blocks"] == 1
    back = np.unique(np.linspace(0, len(p) - 1, LANDING).round().astype(int)) if last else np.zeros(0, dtype=int)
    order = rng.permutation(np.setdiff1d(np.arange(len(p)), back))
    p[order] = flight(size[order], p[order], rng, frame["rows"].to_numpy(dtype=float)[order])
    frame["p"] = landing(size, p) if last else p
    return frame


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """Units (id, th, source) of the documents with rows, size, source_size, target and copies.

    `th` is the hash of the text; join on all three, null-safely, to apply the mix to documents.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    units = cut(rows.groupBy("id", "th", "source").agg(F.count("*").alias("rows"), F.max("size").alias("size")))
    known = cut(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("docs")), weights, share, most))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    known = known.withColumn("ratio", ratio).select(F.col("source").alias("s"), "source_size", "target", "docs", "ratio")
    all_units = units.join(known, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    state = (
        all_units.withColumn("base", F.floor(F.col("ratio") + NEAR))
        .withColumn("p", F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0)))
        .withColumn("weight", F.col("size") * F.col("rows"))
        .withColumn("o", F.xxhash64("id", "th"))
        .withColumn("blocks", F.ceil(F.col("docs") / F.lit(block)).cast("long"))
        .withColumn("b", F.lit(0).cast("long"))
    )
    largest = known.agg(F.max("docs")).first()[0] or 0
    blocks, done = math.ceil(largest / block), []
    fractional = (F.col("p") > NEAR) & (F.col("p") < 1 - NEAR)
    level = 0
    while blocks:
        level += 1
        done.append(state.where(~fractional))
        open_ = state.where(fractional).withColumn("b", F.pmod(F.xxhash64("o", F.lit(level)), F.col("blocks")))
        state = cut(open_.groupBy("source", "b").applyInPandas(fly, open_.schema))
        if blocks == 1:
            break
        blocks = math.ceil(blocks * 2 / block)
        state = state.withColumn("blocks", F.when(fractional, F.ceil(F.col("blocks") * 2 / F.lit(block)).cast("long")).otherwise(F.col("blocks")))
    for d in done:
        state = state.unionByName(d)
    return state.select("id", "th", "source", "rows", "size", "source_size", "target", (F.col("base") + F.round("p")).cast("long").alias("copies"))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    units = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    each = units.withColumn("_row", F.explode(F.expr("sequence(1L, rows)")))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
