"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

Features are character n-grams of orders 1 to 4 of the lower-cased text, hashed to `DIM` buckets; a weight is the
n-gram's share of its text times its inverse document frequency. Document frequencies are counted over all rows that
may be learned from. The weights of the classes are fitted by follow-the-regularised-leader with an elastic-net penalty
on a sample of about `per_class` labelled rows and `chars` characters for each language (the documented bounds on what is
fitted), and a temperature is fitted on the fifth of that sample which the fit does not see.

A text that is null, empty or has no letter is `und` with score 0. With nothing to learn from, every text is `und`. Ties go
to the language that comes first by code point. Repeated rows weigh as often as they occur, and are scored alike; very long
texts are read whole, when scored and when sampled. Rows keep all their columns; `lang_pred` and `lang_score` replace columns
of those names. Rows whose label or id is null are never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks

DIM = 1 << 16
ORDERS = 4
CHUNK = 400_000
PER_CLASS = 1500
CHARS = 6_000_000
SCALE = 20.0
UNKNOWN = "und"
FOLD = np.arange(128, dtype=np.uint32)
FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by ORDERS - 1 zeros, and where each text begins."""
    joined = "".join((t or "").lower().replace("\0", " ") + "\0" * (ORDERS - 1) for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    low = (points < 128) & (points > 0)
    points[low] = FOLD[points[low]]
    starts, at = [], 0
    for t in texts:
        starts.append(at)
        at += len((t or "").lower()) + ORDERS - 1
    return points, np.array(starts, dtype=np.int64)


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram at each place; DIM, which has no weight, at the zeros between texts."""
    padded = np.concatenate([points, np.zeros(ORDERS - 1, dtype=np.uint32)])
    h, pause = np.zeros(len(points), dtype=np.uint32), points == 0
    for n in range(ORDERS):
        h = (h ^ padded[n : n + len(points)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        b = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64)
        b[pause] = DIM
        yield b


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # DIM + 1 rows, idf included
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        points, starts = codes(texts)
        total = np.zeros((len(texts), len(self.labels)))
        for b in grams(points):
            total += np.add.reduceat(self.weights[b], starts, axis=0)
        sizes = np.diff(np.append(starts, len(points))) - (ORDERS - 1)
        return (total * (SCALE / (ORDERS * np.maximum(sizes, 1)))[:, None] + self.bias) / self.temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        z = self.logits(texts)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return [self.labels[i] for i in p.argmax(axis=1)], p.max(axis=1)


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether a row is of the given fold by crc32 of its id as text; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(True))


def document_frequencies(train: DataFrame) -> np.ndarray:
    """Over all training rows: in how many texts each bucket occurs, and the number of texts last."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(DIM + 1, dtype=np.int64), np.zeros(DIM + 1, dtype=bool)
        for frame in frames:
            for t in frame["text"]:
                seen[:] = False
                for b in grams(codes([t])[0]):
                    seen[b] = True
                seen[DIM] = True
                total += seen
        yield pd.DataFrame({"b": np.flatnonzero(total), "n": total[total > 0]})

    got = train.select("text").mapInPandas(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIM + 1, dtype=np.int64)
    out[got["b"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression by FTRL-proximal; L1 sets what has little evidence to 0."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    order = np.random.default_rng(7)
    settled = lambda z, n, l1: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = settled(zi, ni, l1)
            w[-1] = settled(zi[-1], ni[-1], 0.0)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[target[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - step * w
            n[at] = ni + g * g
    w = settled(z, n, l1)
    return w, settled(z[DIM], n[DIM], 0.0)


def temperature(z: np.ndarray, target: np.ndarray) -> float:
    """The scale of the logits that makes the held-back labels likeliest."""
    if not len(z):
        return 1.0

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), target]).mean())

    return float(min(np.geomspace(0.25, 4.0, 49), key=loss))


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their weights; the last is the bias."""
    points, _ = codes([text])
    total = np.zeros(DIM + 1)
    for b in grams(points):
        total += np.bincount(b, minlength=DIM + 1)
    total[DIM] = 0
    at = np.flatnonzero(total)
    x = total[at] * idf[at] * (SCALE / (ORDERS * max(1, len(points) - ORDERS + 1)))
    return np.append(at, DIM), np.append(x, 1.0)


def fit(train: DataFrame, per_class: int = PER_CLASS, chars: int = CHARS) -> Model | None:
    """A model of rows (id, text, lang); about per_class rows of each language, and at most about `chars` characters of it,
    are fitted, chosen by their id's hash. The fit runs in one task of an executor, and only the model comes to the driver."""
    sizes = {r["lang"]: (r["n"], r["c"]) for r in train.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect()}
    if not sizes:
        return None
    df = document_frequencies(train)
    idf = np.log((1 + df[DIM]) / (1 + df)) + 1
    idf[DIM] = 0
    labels = sorted(sizes)
    known = train.sparkSession.sparkContext.broadcast(idf)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_class / n, chars / max(c, 1)))) for k, (n, c) in sizes.items()])
    chosen = train.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003)

    def weighted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(len(frame)):
                row = frame.iloc[i]
                at, x = features(row["text"], known.value)
                yield pd.DataFrame({"at": [at], "x": [x], "lang": [row["lang"]], "back": [row["back"]], "o": [row["o"]]})

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, names, held = [], [], []
        for frame in frames:
            rows += [(np.asarray(a), np.asarray(x)) for a, x in zip(frame["at"], frame["x"], strict=True)]
            names += frame["lang"].tolist()
            held += frame["back"].tolist()
        if rows:
            target, part = np.array([labels.index(x) for x in names], dtype=np.int64), np.array(held)
            weights, bias = ftrl([rows[i] for i in np.flatnonzero(~part)], target[~part], len(labels))
            weights[DIM] = 0
            back = np.flatnonzero(part)
            z = np.array([rows[i][1] @ weights[rows[i][0]] + bias for i in back]).reshape(len(back), len(labels))
            heat = temperature(z, target[back])
            yield pd.DataFrame({"weights": [(weights * known.value[:, None]).tobytes()], "bias": [bias.tobytes()], "heat": [heat]})

    o = F.xxhash64("id", F.lit(2), "text").alias("o")
    sample = chosen.select("text", "lang", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0).alias("back"), o)
    sample = sample.mapInPandas(weighted, "at array<int>, x array<double>, lang string, back boolean, o long")
    got = sample.repartition(1).sortWithinPartitions("o", "lang").drop("o").mapInPandas(fitted, "weights binary, bias binary, heat double").first()
    known.destroy()
    if got is None:
        return None
    weights = np.frombuffer(bytes(got["weights"])).reshape(DIM + 1, len(labels))
    return Model(labels, weights, np.frombuffer(bytes(got["bias"])), got["heat"])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows with `lang_pred` and the calibrated probability `lang_score` of that language."""
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("lang_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for series in batches:
            texts, names, scores = series.tolist(), [], []
            for a, b in chunks(texts, CHUNK):
                got, p = shared.value.predict(texts[a:b])
                names += got
                scores += p.tolist()
            yield pd.DataFrame({"lang": names, "score": scores})

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(predict, "lang string, score double").asNondeterministic()
    whole = F.col(text).cast("string")
    letters = F.coalesce(whole.rlike(r"\p{L}"), F.lit(False))
    return (
        docs.withColumn("_tw_lang", udf(whole))
        .withColumn("lang_pred", F.when(letters, F.col("_tw_lang.lang")).otherwise(UNKNOWN))
        .withColumn("lang_score", F.when(letters, F.col("_tw_lang.score")).otherwise(0.0))
        .drop("_tw_lang")
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """Of documents: rows outside fold 0 of 5 that have a language and a text."""
    return docs.where(~held_out("doc_id", 5, 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("id"), "text", "lang")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(training_rows(docs)))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
