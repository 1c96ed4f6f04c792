"""Document fingerprints: threshold-scaled sketches, in SQL functions alone.

A fingerprint retains every hash of a text's distinct shingles of WIDTH words that lies below the fraction 1 / ONE_IN of
the hash range, whatever the size of the text. So fingerprints of any two texts, however unequal, compare over the same
part of the range, and merge by union. The likeness of two is the share of the smaller one's hashes that the other has:
an estimate of the containment of the smaller text in the larger, with a standard error of sqrt(c (1 - c) / hashes). A text
of fewer words than WIDTH has its whole sequence of words as its one shingle.

A text of n distinct shingles has an empty fingerprint with a chance of (1 - 1 / ONE_IN) ** n (6% for 10, 0.3% for 20). Two
empty fingerprints are equal and have a likeness of 1, which says nothing of the texts; an empty and another one have 0.

Null counts as empty; a table without rows gives none. Next documents follow ascending ids, null first, ties by the hash
of the text; the last is followed by the first, a single document by itself. Only id and text are read, so other columns
may have any names. Ids must be integers. Repeated rows each keep their own row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound

WIDTH = 5
ONE_IN = 4
BELOW = -(1 << 63) + (1 << 64) // ONE_IN


def sketch(text: Column) -> Column:
    """The fingerprint of a text: its shingle hashes below BELOW, as a sorted array<long>."""
    hashes = F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]))
        # A short text's one shingle: null words leave a hash as it is, so the number of words tells the sizes apart.
        one = F.array(F.xxhash64(F.size(h), *[F.get(h, F.lit(k)) for k in range(WIDTH - 1)]))
        return F.when(F.size(h) >= WIDTH, many).when(F.size(h) > 0, one).otherwise(F.array().cast("array<long>"))

    return F.sort_array(F.array_distinct(F.filter(bound(hashes, shingles), lambda x: x < F.lit(BELOW))))


def likeness(a: Column, b: Column) -> Column:
    """The estimated containment of the smaller of two sketches in the other."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.sort_array(F.array_union(a, b))


def as_text(sketch: Column) -> Column:
    return F.concat_ws(",", F.transform(sketch, F.hex))


def followed(docs: DataFrame, doc_id: str, text: str, rows: int = 4000, most_rows: int = 200_000) -> DataFrame:
    """Of each document: id, text, sketch, and `next_text` and `next_sketch` of the next by id.

    Documents are dealt into ranges of ids; the first of a range, and the first of all for the last, also go to the range
    before, so that every document meets its next in one range and no task sorts more than a range.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n, low, nulls = base.agg(F.count("*"), F.min("id"), F.count_if(F.col("id").isNull())).first()
    parts = max(1, math.ceil(n / min(max(rows, n // 200), most_rows)))
    splits: list[int] = []
    if parts > 1:
        found = base.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
        splits = sorted({s for s in found if s > low or nulls})
    step = max(1, math.isqrt(len(splits)))
    array = lambda values, kind: F.from_json(F.lit(str(values)), kind)
    heads, runs = splits[::step], [splits[i : i + step] for i in range(0, len(splits), step)]
    if splits:
        head = F.size(F.filter(array(heads, "array<bigint>"), lambda s: s <= F.col("id")))
        within = F.size(F.filter(F.get(array(runs, "array<array<bigint>>"), head - 1), lambda s: s <= F.col("id")))
        bucket = F.when(F.col("id").isNull() | (head < 1), 0).otherwise((head - 1) * step + within)
        first_of = F.coalesce((bucket > 0) & F.array_contains(F.get(array(runs, "array<array<bigint>>"), head - 1), F.col("id")), F.lit(False))
    else:
        bucket, first_of = F.lit(0), F.lit(False)
    first = F.col("id").isNull() if nulls else F.col("id") == F.lit(low)
    here = F.struct(bucket.cast("int").alias("b"), F.lit(0).alias("place"))
    before = F.when(first_of, F.struct((bucket - 1).cast("int").alias("b"), F.lit(1).alias("place")))
    around = F.when(first, F.struct(F.lit(len(splits)).alias("b"), F.lit(2).alias("place")))
    copies = F.filter(F.array(here, before, around), lambda x: x.isNotNull())
    dealt = base.withColumn("_s", F.explode(F.array(sketch(F.col("text"))))).withColumn("_p", F.explode(copies)).select("id", "text", F.col("_s").alias("sketch"), "_p.b", "_p.place")
    order = Window.partitionBy("b").orderBy("place", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    out = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return out.where("place = 0").select("id", "text", "sketch", "next_text", "next_sketch")


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and of its edited text, and how like they and the next document's are."""
    docs = followed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    docs = docs.withColumn("n", n).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    docs = docs.select("id", "n", "edited", "sketch", "next_sketch", F.explode(F.array(sketch(F.col("edited")))).alias("edited_sketch"))
    return docs.select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).cast("double").alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).cast("double").alias("near_next"),
    )
