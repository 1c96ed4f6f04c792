"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct lower-cased words of a whole text and their beginnings of 4 to 6 letters, hashed to `DIM`
buckets. A logistic regression is fitted on a sample of about `rows` labelled texts (the documented bound on what is
fitted) with an L1 penalty and a counterfactual one: every identity term found in a labelled text is swapped for the
other terms of its group, and the squared change of the score that a swap makes is penalised. So a neutral mention of a
group counts for or against no text.

Scores lie in 0 to 1. Null and empty texts have no features and get the score of the bias alone. With no labelled row,
or only one label, the score is the smoothed share of that label. Very long texts are read whole, by their distinct words.
Repeated rows are scored alike and weigh in the fit as often as they occur, also where one id has several labels; rows tie in
nothing that is returned. A table without rows stays empty. Rows keep all their columns; `toxic_score` replaces a column of
that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out

DIM = 1 << 20
ROWS = 8_000
WORDS = re.compile(r"[^\W_]+")
THRESHOLD = 0.3

# Identity terms by group: fixed values. Swaps stay within a group and a language.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "citizens", "refugees", "foreigners", "natives"),
    ("old", "young"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("ausländer", "deutsche", "migranten"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    ("étrangers", "français", "immigrés"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
    ("extranjeros", "españoles", "inmigrantes"),
)


def word_features(word: str) -> tuple[int, ...]:
    parts = [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)]
    return tuple(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) % DIM for p in parts)


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def swaps(words: set[str], groups=IDENTITY) -> list[tuple[list[int], list[int]]]:
    """For each identity term of a text and each other term of its group: the features that a swap takes and adds."""
    out = []
    for group in groups:
        for term in words.intersection(group):
            rest = {f for w in words if w != term for f in word_features(w)}
            for other in group:
                if other not in words:
                    out.append((sorted(set(word_features(term)) - rest), sorted(set(word_features(other)) - rest)))
    return out


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        for w in words_of(text):
            known = self.cache.get(w)
            if known is None:
                if len(self.cache) > 300_000:
                    self.cache.clear()
                known = self.cache[w] = tuple(f for f in word_features(w) if f in self.weights)
            if known:
                found.update(known)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in sorted(found)), -40, 40))))


class Sparse:
    """Rows of column numbers, with signs where given, without SciPy."""

    def __init__(self, at: np.ndarray, row: np.ndarray, n: int, v: np.ndarray | None = None):
        self.at, self.row, self.n, self.v = at, row, n, v

    def dot(self, w: np.ndarray) -> np.ndarray:
        x = w[self.at] if self.v is None else w[self.at] * self.v
        return np.bincount(self.row, weights=x, minlength=self.n)

    def back(self, r: np.ndarray, dim: int) -> np.ndarray:
        x = r[self.row] if self.v is None else r[self.row] * self.v
        return np.bincount(self.at, weights=x, minlength=dim)


def fit(values: np.ndarray, sizes: np.ndarray, target: np.ndarray, pairs: list[tuple[list[int], list[int]]], l1: float = 1e-4, swap: float = 1.0, steps: int = 250) -> Model:
    """Accelerated proximal gradient descent on the logistic loss, the swap penalty and L1.

    values: the features of all rows, one row after the other; sizes: how many each row has.
    """
    n, hits = len(sizes), float(target.sum())
    if n == 0 or hits in (0.0, float(n)):
        share = (hits + 1) / (n + 2) if n else 0.0
        return Model({}, float(np.log(share / (1 - share))) if n else -40.0)
    swapped = np.array([f for a, b in pairs for f in a + b], dtype=np.int64)
    seen = np.bincount(values, minlength=DIM)
    seen[swapped] += 2
    ids = np.flatnonzero(seen >= (2 if n >= 50 else 1))
    place = np.full(DIM, -1, dtype=np.int32)
    place[ids] = np.arange(len(ids))
    at = place[values]
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)[at >= 0]
    x = Sparse(at[at >= 0], row, n)
    del at, seen
    signs = np.array([s for a, b in pairs for s in [1.0] * len(a) + [-1.0] * len(b)])
    d = Sparse(place[swapped], np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]).astype(np.int64), len(pairs), signs)
    dim, m = len(ids), max(1, len(pairs))
    scale = 1 / np.sqrt(np.maximum(1.0, np.bincount(x.at, minlength=dim) / n * 40))  # frequent features take smaller steps
    w, b = np.zeros(dim), float(np.log(hits / (n - hits)))
    v, c, t = w.copy(), b, 1.0
    rate = 2.0

    def loss(w, b):
        z = x.dot(w) + b
        return float((np.logaddexp(0, z) - target * z).mean() + swap * (d.dot(w) ** 2).sum() / m)

    for _ in range(steps):
        z = x.dot(v) + c
        r = (1 / (1 + np.exp(-z)) - target) / n
        g = (x.back(r, dim) + 2 * swap * d.back(d.dot(v), dim) / m) * scale**2
        g0, f0 = float(r.sum()), loss(v, c)
        while True:
            step = rate * scale**2
            w2 = v - rate * g
            w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - step * l1)
            b2 = c - min(rate, 4.0) * g0
            e = w2 - v
            if rate < 1e-3 or loss(w2, b2) <= f0 + float((g / scale**2) @ e) + g0 * (b2 - c) + float((e * e / (2 * step)).sum()) + (b2 - c) ** 2 / (2 * min(rate, 4.0)) + 1e-12:
                break
            rate /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        moved = float(np.abs(w2 - w).max(initial=0))
        w, b, t = w2, b2, t2
        rate = min(rate * 1.3, 512.0)
        if moved < 1e-4:
            break
    on = np.flatnonzero(w)
    return Model({int(ids[i]): float(w[i]) for i in on}, float(b))


def learn(labelled: DataFrame, rows: int = ROWS, l1: float = 1e-4, swap: float = 1.0) -> Model:
    """A model of labelled rows (id, text, label); about `rows` of them are fitted, chosen by the hash of their id."""
    labelled = labelled.where("label is not null and text is not null")
    total = labelled.count()
    part = min(1.0, rows / total) if total else 1.0

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [words_of(t) for t in frame["text"]]
            swapped = [swaps(w) for w in found]
            yield pd.DataFrame(
                {
                    "o": frame["o"],
                    "label": frame["label"],
                    "f": [sorted({f for w in s for f in word_features(w)}) for s in found],
                    "a": [[p[0] for p in s] for s in swapped],
                    "b": [[p[1] for p in s] for s in swapped],
                }
            )

    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < part * 1_000_003)
    got = chosen.select("text", F.col("label").cast("long").alias("label"), F.xxhash64("id", F.lit(1)).alias("o")).mapInPandas(features, "o long, label long, f array<int>, a array<array<int>>, b array<array<int>>")
    # As Arrow: lists of Python numbers would fill the driver.
    data = got.toArrow().combine_chunks()
    lists = data["f"].chunk(0) if data.num_rows else None
    bounds, flat = (lists.offsets.to_numpy(), lists.values.to_numpy()) if data.num_rows else (np.zeros(1, int), np.zeros(0, np.int32))
    target, o = data["label"].to_numpy(), data["o"].to_numpy()
    order = np.lexsort((np.diff(bounds), target, o))
    pairs = [pair for i in order if (a := data["a"][int(i)].as_py()) for pair in zip(a, data["b"][int(i)].as_py(), strict=True)]
    values = np.concatenate([flat[bounds[i] : bounds[i + 1]] for i in order]) if len(order) else flat
    del data, lists, flat
    return fit(values, np.diff(bounds)[order], (target[order] > 0).astype(float), pairs, l1, swap)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with `toxic_score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for series in batches:
            yield pd.Series([shared.value.score(t) for t in series], dtype="float64")

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("toxic_score", F.pandas_udf(scored, "double")(F.col(text).cast("string")))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    train = docs.where(~held_out("doc_id", 4, 2)).join(labels.where(~held_out("doc_id", 4, 2)), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("toxic").alias("label"))
    out = score(docs, learn(train))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
