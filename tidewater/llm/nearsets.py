"""MinHash near-duplicates, verified by odd sketches and then on full shingle sets.

A text's set is its distinct shingles of `width` words. Texts of equal sets form one class. Each class gets MinHash
samples; bands of them form buckets, and the samples fold into a parity bitmap, the odd sketch, whose XOR with another's
estimates the similarity of the two. Candidates are formed without listing the pairs of a bucket:

1. each member of a bucket is paired with the bucket's smallest and largest class; pairs whose odd sketches rule out the
   threshold fall, the rest are confirmed on full sets, and the confirmed links are joined into components. A second
   parity bitmap takes the whole set as its sample: the XOR's population count is at most the size of the symmetric
   difference, so for sets that do not fill the bitmap it rules pairs out without error;
2. a bucket of more than three classes that now lies in one component can add nothing. The classes of the others are
   joined exactly: shingles are ordered by their frequency among those classes, and classes of different components
   that share a shingle of their necessary prefixes become candidates, filtered by length, position and odd sketch.

So no link that the bands offer is lost. With the bands chosen by `plan`, a pair at the threshold shares none with a
probability under 1e-8. Classes are identified by a 64-bit hash of their set.

Null texts and texts without words have an empty set (n_shingles 0) and are linked with nothing. A text of fewer words
than `width` has its whole sequence as its one shingle. Repeated rows and equal ids each keep their own row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, space_words

BITS = 512
CHUNK = 60_000
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def plan(threshold: float, miss: float = 1e-8, most: int = 256) -> tuple[int, int]:
    """Rows a band and bands: the longest bands that miss a pair at the threshold with a probability under `miss`."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if rows * bands <= most:
            return rows, bands
    raise ValueError("threshold too low for so few samples")


def most_parity(threshold: float, samples: int, sigmas: float = 6.0) -> int:
    """The largest XOR population count that a pair at the threshold can be expected to show."""
    low = max(0.0, threshold - sigmas * math.sqrt(threshold * (1 - threshold) / samples))
    mean = BITS / 2 * -math.expm1(-4 * samples * (1 - low) / BITS)
    return math.ceil(mean + 1.5 * math.sqrt(mean))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = space_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    if len(h) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], dtype=np.uint64)
    s = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for i in range(width):
        s = mixed(s + h[i : len(h) - width + 1 + i] + np.uint64(i + 1))
    return np.unique(s)


def odd_sketch(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Parity bitmaps (n x BITS / 64) of hashes by the number of their owner."""
    place = (hashes >> np.uint64(64 - int(math.log2(BITS)))).astype(np.int64)
    parity = np.bincount(owner * BITS + place, minlength=n * BITS).astype(np.uint8) & 1
    return np.packbits(parity.reshape(n, BITS), axis=1).view(np.int64)


def signatures(sets: list[np.ndarray], rows: int, bands: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x bands) of non-empty sets, and the odd sketches of their samples and of themselves."""
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    flat = np.concatenate(sets)
    low = np.empty((rows * bands, len(sets)), dtype=np.uint64)
    for i, a in enumerate(seeds):
        low[i] = np.minimum.reduceat(flat * a, starts)
    keys = np.empty((bands, len(sets)), dtype=np.uint64)
    for b in range(bands):
        k = np.full(len(sets), b + 1, dtype=np.uint64)
        for r in range(rows):
            k = mixed(k + low[b * rows + r])
        keys[b] = k
    owner = np.arange(len(sets))
    sampled = mixed(low + np.arange(1, rows * bands + 1, dtype=np.uint64)[:, None] * MIX2).ravel()
    odd = odd_sketch(np.tile(owner, rows * bands), sampled, len(sets))
    whole = odd_sketch(np.repeat(owner, [len(s) for s in sets]), mixed(flat), len(sets))
    return np.ascontiguousarray(keys.T).view(np.int64), np.concatenate([odd, whole], axis=1)


def identity(s: np.ndarray) -> int:
    """The class of a set, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def sketched(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """Of (id, text): id, n, nid (null for an empty set), bands and sketch."""
    seeds = np.random.default_rng(20240229).integers(1, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            held: list[tuple[int, np.ndarray]] = []
            size = 0
            ids, texts = frame["id"].tolist(), frame["text"].tolist()
            for i, t in enumerate(texts):
                held.append((i, shingle_set(t, width, hashes)))
                size += len(held[-1][1])
                if size >= CHUNK or i + 1 == len(texts):
                    full = [s for _, s in held if len(s)]
                    keys, odd = signatures(full, rows, bands, seeds) if full else (np.zeros((0, bands)), np.zeros((0, BITS // 32)))
                    at = iter(range(len(full)))
                    out = []
                    for k, s in held:
                        j = next(at) if len(s) else None
                        out.append((ids[k], len(s), None if j is None else identity(s), None if j is None else keys[j].tolist(), None if j is None else odd[j].tolist()))
                    # Each column by its type: through a float, a null beside it would cost a class its last digits.
                    i, n, nid, bk, sk = zip(*out, strict=True)
                    yield pd.DataFrame({"id": i, "n": n, "nid": pd.array(nid, dtype="Int64"), "bands": bk, "sketch": sk})
                    held, size = [], 0

    return docs.mapInPandas(sketch, "id string, n long, nid long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """Of (id, text): nid and the whole set, once for each class."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            for a in range(0, len(frame), 64):
                found = [s for t in frame["text"].iloc[a : a + 64] if len(s := shingle_set(t, width, hashes))]
                yield pd.DataFrame({"nid": [identity(s) for s in found], "set": [s.view(np.int64) for s in found]})

    return docs.mapInPandas(sets, "nid long, set array<long>").dropDuplicates(["nid"])


def may_be_similar(a: str, b: str, na: str, nb: str, num: int, den: int, most: int) -> Column:
    """What sizes and odd sketches allow."""

    def parity(first: int) -> Column:
        return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(first, first + BITS // 64)), F.lit(0))

    sizes = F.least(na, nb) * den >= F.greatest(na, nb) * num
    apart = parity(BITS // 64) * (den + num) <= (F.col(na) + F.col(nb)) * (den - num)
    return sizes & apart & (parity(0) <= most)


def similar(inter: Column, na: Column, nb: Column, num: int, den: int) -> Column:
    return inter * den >= (na + nb - inter) * num


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    one = pairs.join(sets.select(F.col("nid").alias("b"), F.col("set").alias("sb")), "b")
    two = one.join(sets.select(F.col("nid").alias("a"), F.col("set").alias("sa")), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    return two.where(similar(inter, F.size("sa"), F.size("sb"), num, den)).select("a", "b")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """For each row of docs: doc_id, n_shingles and component_id, the smallest doc_id reachable over links.

    Two texts are linked if den * |intersection| >= num * |union| of their sets.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows, bands = plan(num / den)
    most = most_parity(num / den, rows * bands)
    given = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    base = cut(sketched(given, width, rows, bands))
    classes = base.where("n > 0").groupBy("nid").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("id").alias("id"))
    classes = cut(classes)
    member = classes.select("nid", F.explode("bands").alias("k"))
    bucket = member.groupBy("k").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi"), F.count("*").alias("c")).where("lo < hi")
    member = cut(member.join(bucket, "k").select("k", "nid", "lo", "hi", "c"))
    pairs = member.select("nid", F.explode(F.array("lo", "hi")).alias("o")).where("nid <> o").select(F.least("nid", "o").alias("a"), F.greatest("nid", "o").alias("b")).distinct()
    a = classes.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    b = classes.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    fits = may_be_similar("ka", "kb", "na", "nb", num, den, most)
    pairs = cut(pairs.join(a, "a").join(b, "b").where(fits).select("a", "b"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        ids = classes.join(nodes, "nid", "left_semi").select("id").distinct()
        return full_sets(given.join(ids, given["id"].eqNullSafe(ids["id"]), "left_semi"), width)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()

    links = cut(confirmed(pairs, sets_of(ends(pairs)), num, den))
    roots = components(links)
    rooted = lambda df: df.join(roots, df["nid"] == roots["node"], "left").withColumn("root", F.coalesce("root", "nid")).drop("node")
    large = rooted(member.where("c > 3").select("k", "nid"))
    open_k = large.groupBy("k").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("k")
    rest = cut(large.join(open_k, "k", "left_semi").select("nid", "root").distinct())
    if rest.limit(1).count():
        more = cut(prefix_pairs(rest, classes, sets_of(rest.select("nid")), num, den, most))
        extra = cut(confirmed(more, sets_of(ends(more)), num, den))
        if extra.limit(1).count():
            roots = components(links.unionByName(extra))
    out = base.select("id", "n", "nid").join(roots, F.col("nid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "nid")).drop("node")
    typed = F.col("id").cast(kind)
    low = out.where("n > 0").groupBy(F.col("root").alias("r")).agg(F.min(typed).alias("component_id"))
    out = out.join(low, F.col("root") == F.col("r"), "left")
    return out.select(typed.alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(typed).alias("component_id"))


def prefix_pairs(rest: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Candidate pairs of different components among `rest` (nid, root), by rare shingles of their prefixes."""
    tokens = cut(sets.select("nid", F.size("set").alias("n"), F.explode("set").alias("t")))
    counts = tokens.groupBy("t").agg(F.count("*").alias("c"))
    ordered = tokens.join(counts, "t").groupBy("nid", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("s"))
    keep = (F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)) + 1).cast("int")
    prefix = ordered.select("nid", "n", F.posexplode(F.slice("s", F.lit(1), keep)).alias("p", "x")).where("x.c > 1").select("nid", "n", "p", F.col("x.t").alias("t"))
    prefix = prefix.join(rest, "nid").join(classes.select("nid", "sketch"), "nid")
    mixed_t = prefix.groupBy("t").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("t")
    prefix = prefix.join(mixed_t, "t", "left_semi")
    side = lambda x: prefix.select("t", *[F.col(c).alias(f"{c}_{x}") for c in ("nid", "n", "p", "root", "sketch")])
    room = (1 + F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) - 1) * (den + num) >= (F.col("n_a") + F.col("n_b")) * num
    fits = room & may_be_similar("sketch_a", "sketch_b", "n_a", "n_b", num, den, most)
    both = side("a").join(side("b"), "t").where((F.col("nid_a") < F.col("nid_b")) & (F.col("root_a") != F.col("root_b")) & fits)
    return both.select(F.col("nid_a").alias("a"), F.col("nid_b").alias("b")).distinct()


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, a similarity of 85 in 100."""
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=85, den=100)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 2], ' ') END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), walk AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT walk.a, e.b FROM walk JOIN e ON e.a = walk.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""
