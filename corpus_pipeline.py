"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of documents; the last
adds `copies`, how often the mix takes a document. Null ids are handled; rows equal in id and text are one document, which
near_dedup keeps once. Empty tables give empty results. Columns beside doc_id, text, lang, source and n_chars are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, langid, lines, mixing, nearsets
from tidewater.llm.common import cut

LEAST_SCORE = 0.5
CONTAINMENT = 0.8
WINDOW = 5
PASSAGE = 13


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with a calibrated probability of LEAST_SCORE; texts without letters go."""
    found = langid.identify(docs, langid.fit(langid.training_rows(docs)))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that lose lines and keep nothing but blank text go."""
    out = lines.dedup_lines(docs, whole=True)
    out = out.where((F.col("lines_out") == 0) | F.col("text").rlike(r"[^\s\p{Z}]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near-duplicates (5-word shingles, 0.8)."""
    groups = nearsets.near_groups(docs, width=5, num=80, den=100)
    groups = groups.groupBy("doc_id").agg(F.count("*").alias("_rows"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_first"))
    kept = groups.where("_first").select(F.col("doc_id").alias("_kept"), "_rows")
    out = cut(docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"])).drop("_kept"))
    # Only of an id that several rows have are texts compared.
    again = out.where("_rows > 1").dropDuplicates(["doc_id", "text"])
    return out.where("_rows = 1").unionByName(again).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, an item being held where CONTAINMENT of its windows occur in its length, or PASSAGE words of it in a row."""
    found = decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=WINDOW)
    return found.where(~F.exists("hits.items", lambda x: (x["containment"] >= CONTAINMENT) | (x["longest"] >= PASSAGE))).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `copies`, how often it takes each."""
    units = mixing.mix(docs).select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("source").alias("_source"), "copies").where("copies > 0")
    same = docs["doc_id"].eqNullSafe(units["_id"]) & (F.xxhash64(docs["text"].cast("string")) == units["_th"]) & docs["source"].eqNullSafe(units["_source"])
    return docs.drop("copies").join(units, same).drop("_id", "_th", "_source")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
