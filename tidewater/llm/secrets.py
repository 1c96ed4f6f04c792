"""Secret scans over a trigram inverted index, in SQL functions alone.

Each rule is a regular expression. From it a Boolean trigram query is derived: conditions that all must hold, each a
choice of clauses, each clause a set of trigrams that all must occur. The index posts, for the trigrams that the queries
name, the texts that hold them in lower case; a text is known by a 64-bit hash, so copies are posted once and a clash of
hashes only adds a candidate. Intersecting the postings gives the candidates of each rule, on which alone its expression
runs. Rules without mandatory trigrams scan every text.

Null counts as empty; an empty table gives an empty result. Rows keep their ids whatever they are; repeated rows get equal
results, and of several kinds that begin at one place the order is that of the rules. Spans are in code points. Only id and
text are read, so other columns may have any names. Expressions hold no repeated groups, which Java would match by
recursion, and places are summed in blocks, so very long texts and very many matches cost no stack and no squared time.
"""

from __future__ import annotations

import re._constants as sre
import re._parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, cut

MOST_STRINGS = 64
# Candidates are rows of a hash and a bit mask, 64 bytes at most in a broadcast: so many of them take 64 MB.
BROADCAST_KEYS = 1_000_000
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0  # shorter matches are dropped
    base: bool = False


# The base kinds in their order, then public token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


Condition = frozenset[frozenset[str]]


def derive(pattern: str) -> set[Condition]:
    """The conditions of a pattern's trigram query, in lower case; none means that every text must be scanned."""
    exact, conditions = _walk(re._parser.parse(pattern))
    return conditions | _condition(exact)


def _condition(strings: set[str] | None) -> set[Condition]:
    if not strings or any(len(s) < 3 for s in strings):
        return set()
    clauses = {trigrams(s) for s in strings}
    return {frozenset(c for c in clauses if not any(d < c for d in clauses))}


def _walk(items) -> tuple[set[str] | None, set[Condition]]:
    """The strings that the items match, if they are few; and conditions met whenever they match."""
    whole, run, found = True, {""}, set()

    def put(strings: set[str] | None) -> None:
        nonlocal whole, run, found
        longer = None if strings is None else {a + b for a in run for b in strings}
        if longer is not None and len(longer) <= MOST_STRINGS:
            run = longer
            return
        whole = False
        found |= _condition(run)
        run = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}

    for op, arg in items:
        if op is sre.LITERAL:
            put({chr(arg).lower()})
        elif op is sre.IN:
            put(_members(arg))
        elif op is sre.SUBPATTERN:
            exact, inner = _walk(arg[-1])
            found |= inner
            put(exact)
        elif op is sre.BRANCH:
            ways = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in ways):
                put(set().union(*[e for e, _ in ways]))
            else:
                each = [next(iter(sorted(c | _condition(e), key=lambda c: sorted(map(sorted, c)))), None) for e, c in ways]
                if all(c is not None for c in each):
                    found.add(frozenset().union(*each))
                put(None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            exact, conditions = _walk(inner)
            if low:
                found |= conditions
            if exact is not None and high is not sre.MAXREPEAT and high <= 4:
                times, all_times = {""}, set()
                for k in range(high + 1):
                    all_times |= times if k >= low else set()
                    times = {a + b for a in times for b in exact}
                put(all_times if len(all_times) <= MOST_STRINGS else None)
            else:
                for _ in range(min(low, 3)):
                    put(exact)
                put(None)
        elif op is not sre.AT:
            put(None)
    return (run, found) if whole else (None, found | _condition(run))


def _members(parts) -> set[str] | None:
    out: set[str] = set()
    for op, arg in parts:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def running(values: Column) -> Column:
    """The sum of all values before each, by appending, which copies the array."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, begin, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def placed(sizes: Column) -> Column:
    """Of array<struct<gap, size, own>>: array<struct<at, size, own>>, where `at` is the sum of all before and the gap.

    Sums run over blocks of BLOCK matches, and over the blocks' own sums, so the copies stay short.
    """

    def block_of(block: Column, begin: Column) -> Column:
        before = running(F.transform(block, lambda m: m["gap"] + m["size"]))
        return F.zip_with(block, before, lambda m, o: F.struct((begin + o + m["gap"]).alias("at"), m["size"].alias("size"), m["own"].alias("own")))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda t, m: t + m["gap"] + m["size"]))
        return F.flatten(F.zip_with(blocks, running(totals), block_of))

    def cut_up(all_sizes: Column) -> Column:
        last = F.floor((F.size(all_sizes) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_sizes, b * BLOCK + 1, F.lit(BLOCK)))

    return bound(sizes, lambda all_sizes: bound(cut_up(all_sizes), joined))


def spans(text: Column, rule: Rule) -> Column:
    """All kept matches of a rule as array<struct<start, past>>, leftmost and not overlapping."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else None
    # split gives one piece more than there are matches.
    parts = [F.split(text, rule.pattern, -1).alias("g"), whole.alias("w")] + ([own.alias("o")] if rule.group else [])
    matches = F.filter(F.arrays_zip(*parts), lambda m: m["w"].isNotNull())
    sizes = F.transform(matches, lambda m: F.struct(F.length(m["g"]).alias("gap"), F.length(m["w"]).alias("size"), F.length(m["o" if rule.group else "w"]).alias("own")))
    kept = F.filter(placed(sizes), lambda m: m["own"] >= rule.least)
    found = F.transform(kept, lambda m: F.struct(m["at"].alias("start"), (m["at"] + m["size"]).alias("past")))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast("array<struct<start:int,past:int>>"))


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The index: (gram, key) for each wanted trigram and each distinct text that holds it. docs: (key, text)."""
    low = docs.select("key", F.lower("text").alias("t"))
    held = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in wanted]))
    return low.select("key", F.explode(held).alias("gram")).distinct()


def query_table(spark: SparkSession, queries: dict[str, set[Condition]]) -> DataFrame:
    """Rows (kind, conditions, condition, clause, size, gram): fixed by the rules, not by the data."""
    rows = []
    for kind, conditions in queries.items():
        for i, condition in enumerate(sorted(conditions, key=lambda c: sorted(map(sorted, c)))):
            for j, clause in enumerate(sorted(condition, key=sorted)):
                rows += [(kind, len(conditions), i, j, len(clause), g) for g in sorted(clause)]
    return spark.createDataFrame(rows, "kind string, conditions int, condition int, clause int, size int, gram string")


def candidates(index: DataFrame, queries: dict[str, set[Condition]]) -> DataFrame:
    """(kind, key) of the texts that meet all conditions of a rule, by intersecting postings."""
    met = (
        index.join(F.broadcast(query_table(index.sparkSession, queries)), "gram")
        .groupBy("key", "kind", "conditions", "condition", "clause", "size")
        .agg(F.count("*").alias("c"))
        .where("c = size")
    )
    return met.groupBy("key", "kind", "conditions").agg(F.count_distinct("condition").alias("c")).where("c = conditions").select("key", "kind")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each row of docs: the id and `spans`, array<struct<start, rank, kind, past>> by start, then rule order."""
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    queries = {r.kind: derive(r.pattern) for r in rules}
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,past:int>>")

    def tagged(rank: int, rule: Rule) -> Column:
        return F.transform(spans(F.col("text"), rule), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["past"].alias("past")))

    indexed = {k: q for k, q in queries.items() if q}
    held = base.withColumn("mask", F.lit(0))
    if indexed:
        wanted = sorted({g for q in indexed.values() for condition in q for clause in condition for g in clause})
        bit = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(1 << i)) for i, r in enumerate(rules)])
        keys = cut(candidates(postings(base.select("key", "text"), wanted), indexed).groupBy("key").agg(F.bit_or(bit).alias("mask")))
        held = base.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left")
    hits = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, tagged(i, r)).otherwise(none) if queries[r.kind] else tagged(i, r) for i, r in enumerate(rules)]
    return held.select(F.col("id").alias(doc_id), F.array_sort(F.concat(none, *hits)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["past"])))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(RULES):
        parts.append(f"""
  SELECT r, {i} AS k, '{r.kind}' AS kind, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g,
         string_split_regex(t, {quoted(r.pattern)}) AS s, {r.least} AS least FROM d WHERE regexp_matches(t, {quoted(r.pattern)})""")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), x AS ({" UNION ALL ".join(parts)}
), y AS (
  SELECT r, k, kind, least, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM x
), z AS (
  SELECT r, k, kind, least, length(g[i]) AS own, length(array_to_string(s[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS a, length(m[i]) AS n FROM y
), f AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans
  FROM z WHERE own >= least GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (r)
"""


SQL = _sql()
