"""Benchmark decontamination: a prefix-filtered set join of item shingles against whole documents.

Shingles of an item are its windows of `window` consecutive words (an item of fewer words is one window). Words are
ordered by rarity, counted over all documents. For exact containment of a window of k words the necessary prefix is its
k - k + 1 = 1 rarest word, the anchor: a document can hold the window only where it holds the anchor, at the anchor's
offset (positional bound) and with room for k words (length bound). What survives is verified word by word.

The items are read in blocks of a bounded number of characters, each of which is broadcast on its own; a benchmark
beyond one block takes further passes, so no broadcast grows with the benchmark.

Null and empty texts have no words and no hits; an item without words is never found. Repeated documents and items are
handled row by row; items of equal id count once. Items of null id are items by their text: their windows are hits, and
they are listed with a null id, which op9 does not count among the items. All columns of the documents stay, whatever their names, except that
`hits` replaces a column of that name.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut

# An index takes about 44 MB a million characters, in the driver and in each Python worker.
BLOCK_CHARS = 4_000_000
HITS = "struct<n_words:bigint,ranges:array<struct<first:bigint,past:bigint>>,items:array<struct<item_id:string,found:bigint,total:bigint,containment:double,longest:bigint>>>"


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """The windows of an item, in order."""
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


class Index:
    """One block of items, keyed by the anchor of each window."""

    def __init__(self, items: list[tuple[tuple[bool, str], str | None]], window: int, counts: dict[bytes, int]):
        self.windows: dict[tuple[bytes, ...], list[tuple[bool, str]]] = {}
        self.total: dict[tuple[bool, str], int] = {}
        of_item: dict[tuple[bool, str], set] = defaultdict(set)
        for item_id, text in items:
            of_item[item_id].update(item_windows(alnum_words(text), window))
        for item_id, found in of_item.items():
            self.total[item_id] = len(found)
            for w in found:
                self.windows.setdefault(w, []).append(item_id)
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        places: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for w in self.windows:
            at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
            places[w[at]].add((at, len(w)))
        self.anchors = {k: sorted(v) for k, v in places.items()}

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[dict]]:
        """Merged hit ranges, and what was found of each item."""
        here = self.anchors.keys() & set(words)
        if not here:
            return [], []
        n, spans, starts = len(words), [], defaultdict(list)
        for p, word in enumerate(words):
            if word in here:
                for at, size in self.anchors[word]:
                    first = p - at
                    if first >= 0 and first + size <= n and (key := tuple(words[first : first + size])) in self.windows:
                        spans.append((first, first + size))
                        for item_id in self.windows[key]:
                            starts[item_id].append((first, key))
        return merged(spans), [{"item_id": k[1] if k[0] else None, "found": len({key for _, key in v}), "total": self.total[k], "containment": densest(v, self.total[k]), "longest": longest(v)} for k, v in sorted(starts.items())]


def densest(found: list[tuple[int, tuple]], total: int) -> float:
    """The largest share of an item's windows that start within one item-sized stretch of the document."""
    found, held, best, low = sorted(found), Counter(), 0, 0
    for start, key in found:
        held[key] += 1
        while found[low][0] <= start - total:
            held[found[low][1]] -= 1
            if not held[found[low][1]]:
                del held[found[low][1]]
            low += 1
        best = max(best, len(held))
    return best / total


def longest(found: list[tuple[int, tuple]]) -> int:
    """The words of the longest passage in which every window of the item's size begins one word after another."""
    best, run, before = 0, 0, None
    for start, size in sorted({(start, len(key)) for start, key in found}):
        run = run + 1 if before == start - 1 else 1
        best, before = max(best, run + size - 1), start
    return best


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(past, out[-1][1]))
        else:
            out.append((first, past))
    return out


def word_counts(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary, which is of one block, occurs in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = known.value, Counter()
        for frame in frames:
            for t in frame.iloc[:, 0]:
                total.update(filter(words.__contains__, alnum_words(t)))
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    found = docs.select(F.col(text).cast("string").alias("t")).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    known.destroy()
    return {bytes(r["word"]): r["n"] for r in found}


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with a struct `hits`: n_words, merged ranges of hit words, and the items found.

    For each item: its windows found, how many it has, and the containment in the best item-sized stretch.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(blocks)))
    out = docs.drop("hits")
    for k in range(blocks):
        rows = [((r["item_id"] is not None, r["text"] or "" if r["item_id"] is None else r["item_id"]), r["text"]) for r in items.where(F.col("block") == k).select("item_id", "text").collect()]
        vocabulary = {w for _, t in rows for w in alnum_words(t)}
        index = docs.sparkSession.sparkContext.broadcast(Index(rows, window, word_counts(docs, text, vocabulary)))
        out = out.withColumn("hits", searcher(index)(F.col(text).cast("string"), F.col("hits") if k else F.lit(None).cast(HITS)))
        if blocks > 1:
            out = cut(out)
    return out


def searcher(index):
    def search(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, before in batches:
            rows = []
            for t, old in zip(texts, before["ranges"] if "ranges" in before else [None] * len(texts), strict=True):
                words = alnum_words(t)
                ranges, items = index.value.search(words)
                rows.append((len(words), ranges, items, old))
            known = before["items"] if "items" in before else [None] * len(texts)
            yield pd.DataFrame(
                {
                    "n_words": [r[0] for r in rows],
                    "ranges": [[{"first": a, "past": b} for a, b in merged(r[1] + [(x["first"], x["past"]) for x in (r[3] if r[3] is not None else [])])] for r in rows],
                    "items": [[dict(x) for x in (o if o is not None else [])] + r[2] for r, o in zip(rows, known, strict=True)],
                }
            )

    # The types are given here, as annotations are strings in this module.
    search.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.DataFrame]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(search, HITS).asNondeterministic()


def hit_words(hits: str = "hits") -> Column:
    """How many words of a document are inside a found window."""
    return F.aggregate(F.col(f"{hits}.ranges"), F.lit(0).cast("long"), lambda a, r: a + r["past"] - r["first"])


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark, with windows of 8 words; two items found make it contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.array_compact(F.array_distinct(F.col("hits.items.item_id"))))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.size(ids) >= 2).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[p:p + 7], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 6))) AS p FROM i WHERE len(w) > 0)
), dp AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d
), hit AS (
  SELECT dp.r, dp.p, z.k, iw.item_id
  FROM dp CROSS JOIN (SELECT DISTINCT k FROM iw) z
  JOIN iw ON iw.k = z.k AND iw.win = array_to_string(dp.w[dp.p:dp.p + z.k - 1], ' ')
  WHERE dp.p + z.k - 1 <= len(dp.w)
), nh AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r
), ni AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""
