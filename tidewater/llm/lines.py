"""Fuzzy line deduplication, in SQL functions alone.

Lines are normalised (lower case; runs of anything but letters and digits become one space; each letter of a script
written without spaces is a word of its own). Equal normalised lines are one class, and a line that only occurs once in
its class may still be near another. Each class gets a 64-bit SimHash of its distinct words, counted in lanes packed into
longs. Classes within RADIUS bits are found by the pigeonhole principle: of `blocks` blocks at least blocks - RADIUS must
agree, so classes are joined on each choice of that many blocks, and pairs beyond RADIUS bits or with lengths far apart
fall inside the join. What is left is verified by edit similarity in words, 1 - edits / longer length >= `least`, and
joined into connected groups. Of each group the first occurrence, by (id, text hash, place), is kept; the others are taken
out of their documents.

SimHash reaches few of the pairs at `least`, as one changed word of a short line flips many bits. With `whole`, which the
queries set, an exact join finds the rest: a line of n words and one within the similarity share one of the
floor(2 (1 - least) n) + 1 rarest pairs of adjacent words of each, as an edit breaks two such pairs at most. Rarity is
that of the pair itself, read from COUNTERS counters over the word pairs of all lines, so that a passage which many unlike lines hold is
no key of theirs; any order gives the same links. Every line meets
the ends of its keys, as those of its SimHash buckets, and lines of one group are not compared again. Candidates whose words, repeats told apart,
differ in more bits of a parity sketch than the edits allowed can flip at these lengths fall inside the join; lines of over TOKENS words have
no such sketch. Lines of LONG words or more, which fill it, have one of WIDE longs beside. With `whole`, lines of fewer than `min_words` words
take part too, as exact copies only.

More blocks make longer join keys, so the number of blocks follows the number of classes; the pairs found do not depend
on it. Edits are of words, compared by 32-bit hashes and two codes of CODES. Of lines that differ but share the 64-bit hash of their class, those
are classes of another hash.

Null and empty texts have no lines and stay as they are; an empty table stays empty. Rows equal in id and text count as
one occurrence. Rows keep all their columns, whatever their names (`lines` and `lines_out` are replaced); ids may be null.
Lines of any length take part: SimHash counters of 8, 16 or 64 bits are chosen by the number of words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, dropped, stored

RADIUS = 3
LEAST = 0.8
MIN_WORDS = 5
CODES = 0xC800
COUNTERS = 1 << 20
SLICES = 3
PARITY = 4
TOKENS = 4096
WIDE = 16
LONG = 160
PARITIES = [f"p{j}" for j in range(PARITY)]
SKETCH = [*PARITIES, "wide"]
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def normal_lines(text: Column) -> Column:
    """The normalised lines of a whole text, some of them empty, with a space at either end perhaps."""
    low = F.lower(text)
    # Letters of the scripts without spaces take three bytes, and lie beyond all that is cheap to tell.
    apart = F.when((F.octet_length(low) >= F.length(low) + 2) & low.rlike(r"[\x{0E00}-\x{10FFFF}]"), F.regexp_replace(low, UNSPACED, " $1 ")).otherwise(low)
    return F.split(F.regexp_replace(apart, r"[^\p{L}\p{Nd}\n]+", " "), "\n", -1)


def lane_counts(h: Column, lane: int) -> list[Column]:
    """A hash's bits as 64 / lane counters in each of `lane` longs; sums of these count the bits of many hashes."""
    ones = F.lit(sum(1 << i for i in range(0, 64, lane)))
    return [F.shiftrightunsigned(h, j).bitwiseAND(ones) for j in range(lane)]


def majority(n: Column, lane: int, counter: Callable[[int], Column]) -> Column:
    """Bit i is set where more than half of n hashes have it set, by the counters of `lane_counts`; n < 2 ** (lane - 1), so that none runs over."""
    ones, half = sum(1 << i for i in range(0, 64, lane)), (1 << (lane - 2)) - 1
    bits = F.lit(0).cast("long")
    for j in range(lane):
        over = (counter(j) + (F.lit(half).cast("long") - F.floor(n / 2)) * F.lit(ones)).bitwiseAND(F.lit(ones << (lane - 2)))
        bits = bits.bitwiseOR(F.shiftleft(F.shiftrightunsigned(over, lane - 2), j))
    return bits


def wide_simhash(hashes: Column) -> Column:
    """The same for hashes of any number, bit by bit."""

    def bit(i: int) -> Column:
        on = F.size(F.filter(hashes, lambda h: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1).cast("long")) == 1))
        return F.shiftleft((on * 2 > F.size(hashes)).cast("long"), i)

    out = bit(0)
    for i in range(1, 64):
        out = out.bitwiseOR(bit(i))
    return out


def long_simhash(words: Column) -> Column:
    """The SimHash of an array of distinct words of any size."""
    return wide_simhash(F.transform(words, lambda w: F.xxhash64(F.hash(w))))


def sketched(rows: DataFrame) -> DataFrame:
    """Rows, equal ones once, with the word hashes `h`: with `sim` of their distinct words, and the parities of their tokens.

    A token is a word and how often it came before in the line, so that repeats are different tokens. Each flips one bit of
    PARITY longs, and of WIDE longs in lines of LONG words or more; lines of over TOKENS words have neither. Words are counted as rows, in the partitions that rows are in if
    these are by some of their columns.
    """
    most, zero = 1 << 15, F.lit(0).cast("long")
    words = rows.withColumn("_s", F.sort_array("h")).select(*rows.columns, "_s", F.posexplode("_s").alias("_i", "_w"))
    again = F.coalesce(F.get("_s", F.col("_i") - 1) == F.col("_w"), F.lit(False))
    token = F.when(again, F.xxhash64("_w", F.col("_i") + 1 - F.array_position("_s", F.col("_w")))).otherwise(F.xxhash64("_w"))
    words = words.select(*rows.columns, (~again).alias("_new"), token.alias("_t"))
    counted = F.col("_new") & (F.size("h") < most)
    sums = [F.sum(F.when(counted, x).otherwise(zero)).alias(f"c{j}") for j, x in enumerate(lane_counts(F.col("_t"), 16))]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("_t", 50).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    # Two bits choose the long of the narrow sketch, two more the part of the wide one that is added up to it.
    narrow, part = (F.shiftrightunsigned("_t", i).bitwiseAND(F.lit(3).cast("long")) for i in (48, 56))
    own = F.when(F.size("h") <= TOKENS, narrow + part * PARITY)
    flips = [F.bit_xor(F.when(own == j, bit).otherwise(zero)).alias(f"w{j}") for j in range(WIDE)]
    found = words.groupBy(*rows.columns).agg(*sums, F.count_if("_new").alias("_n"), *flips)
    sim = F.when(F.size("h") < most, majority(F.col("_n"), 16, lambda j: F.col(f"c{j}"))).otherwise(wide_simhash(F.transform(F.array_distinct("h"), lambda w: F.xxhash64(w))))
    folded = [reduce(Column.bitwiseXOR, [F.col(f"w{i}") for i in range(j, WIDE, PARITY)]).alias(p) for j, p in enumerate(PARITIES)]
    wide = F.when(F.size("h").between(LONG, TOKENS), F.array(*[F.col(f"w{j}") for j in range(WIDE)])).alias("wide")
    return found.select(*rows.columns, sim.alias("sim"), *folded, wide)


def scheme(classes: int) -> tuple[int, int]:
    """How many blocks, and how many of them a join key takes, for a number of classes."""
    blocks = RADIUS + (1 if classes <= 1 << 22 else 2 if classes <= 1 << 31 else 3)
    return blocks, blocks - RADIUS


def block_keys(sim: Column, blocks: int, taken: int) -> Column:
    """One key for each choice of `taken` blocks, as an array."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(sim, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(i), *[part[k] for k in chosen]) for i, chosen in enumerate(combinations(range(blocks), taken))])


def placed_lines(docs: DataFrame, min_words: int, clashing: DataFrame | None = None) -> DataFrame:
    """Of (id, text): id, th, place and class (line, line2) of every line that takes part, and its normal form `norm`."""
    lines = docs.select("id", F.xxhash64("text").alias("th"), F.posexplode(normal_lines(F.col("text"))).alias("place", "x"))
    lines = lines.select("id", "th", F.col("place").cast("long").alias("place"), F.trim("x").alias("norm")).where("norm <> ''")
    if min_words > 1:
        lines = lines.where(F.regexp_count("norm", F.lit(" ")) >= min_words - 1)
    out = lines.select("id", "th", "place", F.xxhash64("norm").alias("line"), F.xxhash64("norm", F.lit(1)).alias("line2"), "norm")
    if clashing is not None:
        other = out.join(clashing.withColumn("_again", F.lit(True)), "line", "left")
        out = other.withColumn("line", F.when(F.col("_again"), F.xxhash64("line", "line2")).otherwise(F.col("line"))).drop("_again")
    return out


def with_words(rows: DataFrame) -> DataFrame:
    """Rows of normalised lines with `h`, the hashes of their words, and `len` in place of `norm`."""
    hashed = rows.withColumn("_h", F.explode(F.array(F.transform(F.split("norm", " "), lambda w: F.hash(w)))))
    return hashed.select(*[c for c in rows.columns if c != "norm"], F.size("_h").cast("long").alias("len"), F.col("_h").alias("h"))


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """Of (id, text): id, th, place, class, length, words, SimHash and parities of every line that takes part."""
    return sketched(with_words(placed_lines(docs, min_words)))


def classes_of(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame | None]:
    """(line, len, h, c, sim, parities) of every distinct line, c being how often it occurs; and the hashes that clash."""
    clashing = None
    while True:
        grouped = placed_lines(docs, min_words, clashing).groupBy("line").agg(F.first("norm").alias("norm"), F.count("*").alias("c"), F.min("line2").alias("x"), F.max("line2").alias("y"))
        out = stored(sketched(with_words(grouped)))
        if clashing is not None or not out.where("x <> y").limit(1).count():
            return out.where("x = y").drop("x", "y"), clashing
        clashing = cut(out.where("x <> y").select("line"))
        dropped(out)


def keyed(classes: DataFrame, blocks: int, taken: int) -> DataFrame:
    return classes.withColumn("k", F.explode(block_keys(F.col("sim"), blocks, taken)))


def near(a: DataFrame, b: DataFrame, least: float, more: Column) -> DataFrame:
    """Pairs (a, b), a < b, of a shared key, within RADIUS bits and of lengths that allow the similarity."""
    a = a.select("k", *[F.col(c).alias(f"{c}_a") for c in ("line", "sim", "len", "root")])
    b = b.select("k", *[F.col(c).alias(f"{c}_b") for c in ("line", "sim", "len", "root")])
    lengths = F.least("len_a", "len_b") >= F.greatest("len_a", "len_b") * F.lit(least) - F.lit(1e-9)
    fits = (F.bit_count(F.col("sim_a").bitwiseXOR(F.col("sim_b"))) <= RADIUS) & lengths & more
    return a.join(b, "k").where(fits).select(F.least("line_a", "line_b").alias("a"), F.greatest("line_a", "line_b").alias("b")).distinct()


def grams(h: str) -> Column:
    """The hashes of all pairs of adjacent words, repeats too."""
    return F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))


def word_ranks(classes: DataFrame) -> bytes:
    """For each of COUNTERS buckets of the hashes in `h`, of words or of word pairs, 8 log2(1 + n), 127 at most, n being how often they occur in all classes.

    The table is put together in one task, so that the driver gets one value.
    """
    words = classes.select(F.explode("h").alias("w")).select(F.pmod("w", F.lit(COUNTERS)).cast("long").alias("b"), F.lit(1).alias("n"))
    every = words.unionByName(classes.sparkSession.range(0, COUNTERS, 1, 1).select(F.col("id").alias("b"), F.lit(0).alias("n")))
    rank = F.least(F.lit(127), F.floor(F.lit(8) * F.log2(F.lit(1) + F.sum("n"))))
    byte = F.lpad(F.hex(rank.cast("long")), 2, "0").alias("x")
    table = every.groupBy("b").agg(byte).agg(F.sort_array(F.collect_list(F.struct("b", "x"))).alias("t"))
    return bytes(table.select(F.unhex(F.array_join("t.x", "")).alias("t")).first()["t"])


def rare_keys(classes: DataFrame, least: float) -> DataFrame:
    """(line, k): the rarest word pairs of every class."""
    # One binary value, which no row has to carry.
    ranks = F.lit(word_ranks(classes.select(grams("h").alias("h"))))
    rank = lambda g: F.ascii(F.substring(ranks, F.pmod(g, F.lit(COUNTERS)).cast("int") + 1, F.lit(1)).cast("string"))
    # The rank goes into the top of the hash, so that plain numbers are sorted.
    ranked = F.transform(grams("h"), lambda g: g.bitwiseAND(F.lit((1 << 55) - 1)).bitwiseOR(F.shiftleft(rank(g).cast("long"), 55)))
    # Of a line's pairs, repeats count too: without them the prefix is a longer part of the rest, never a shorter one.
    size = F.floor(F.col("len") * F.lit(2 * (1 - least)) + F.lit(1e-9)).cast("int") + 1
    return classes.select("line", F.explode(F.slice(F.sort_array(F.array_distinct(ranked)), F.lit(1), size)).alias("k"))


def shared_keys(classes: DataFrame, least: float) -> DataFrame:
    """(line, k, c) of the rare word pairs that several lines have, c being how many."""
    of_key = Window.partitionBy("k")
    keys = rare_keys(classes, least).repartition("k").withColumn("c", F.count("*").over(of_key))
    return cut(keys.where("c > 1"))


def allowed(a: str, b: str, least: float) -> Column:
    """What roots, lengths and parities of two sides allow; columns are named by a prefix and a suffix.

    The tokens that only one line has are at least as many as the bits that differ, and those of the longer line exceed
    those of the shorter by the difference of lengths; the edits are at least as many as either.
    """
    of = lambda c: (F.col(a.format(c)), F.col(b.format(c)))
    longer, shorter = F.greatest(*of("len")), F.least(*of("len"))
    flips = lambda pairs: sum((F.bit_count(x.bitwiseXOR(y)) for x, y in pairs), F.lit(0))
    (ra, rb), (wa, wb) = of("root"), of("wide")
    most = 2 * F.floor(longer * F.lit(1 - least) + F.lit(1e-9)) - (longer - shorter)
    apart = (flips(map(of, PARITIES)) > most) & (longer <= TOKENS)
    far = F.when(wa.isNotNull() & wb.isNotNull(), flips((F.get(wa, i), F.get(wb, i)) for i in range(WIDE)) > most).otherwise(F.lit(False))
    return (ra != rb) & (shorter >= longer * F.lit(least) - F.lit(1e-9)) & ~apart & ~far


def met_ends(every: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of the smallest and the largest line of each key with its others, which are all pairs of keys of three."""
    one, of_key = F.struct("line", "len", "root", *SKETCH), Window.partitionBy("k")
    met = every.repartition("k").withColumn("lo", F.min(one).over(of_key)).withColumn("hi", F.max(one).over(of_key))
    met = met.withColumn("o", F.explode(F.array("lo", "hi"))).drop("lo", "hi")
    return met.where(allowed("{}", "o.{}", least)).select(F.least("line", "o.line").alias("a"), F.greatest("line", "o.line").alias("b")).distinct()


def alike(every: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of a shared key and different roots that lengths and parities do not rule out."""
    a, b = [every.select("k", *[F.col(c).alias(f"{c}_{s}") for c in ("line", "len", "root", *SKETCH)]) for s in "ab"]
    return a.join(b, "k").where(allowed("{}_a", "{}_b", least)).select(F.least("line_a", "line_b").alias("a"), F.greatest("line_a", "line_b").alias("b")).distinct()


def rooted(classes: DataFrame, roots: DataFrame, *more: str) -> DataFrame:
    """(line, len, more columns, root) of all classes."""
    return classes.join(roots, F.col("line") == F.col("node"), "left").select("line", "len", *more, F.coalesce("root", "line").alias("root"))


def widened(classes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(node, root) with the links that SimHash's `pairs` miss: the ends of each key first, then keys that hold several groups.

    The keys meet in SLICES parts, one after the other, so that the disks hold the shuffle of one part only.
    """
    keys, parts = shared_keys(classes, least), [pairs]
    every = keys.join(classes.select("line", "len", *SKETCH, F.col("line").alias("root")), "line")
    for i in range(SLICES):
        parts.append(cut(met_ends(every.where(F.pmod("k", F.lit(SLICES)) == i), least)))
    links = cut(linked(classes, reduce(DataFrame.unionByName, parts).distinct(), least))
    roots = components(links)
    large = keys.where("c > 3").join(rooted(classes, roots, *SKETCH), "line")
    still = large.groupBy("k").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("k")
    pairs = cut(alike(large.join(still, "k"), least))
    more = cut(linked(classes, pairs, least))
    return components(links.unionByName(more)) if more.limit(1).count() else roots


def stars(classes: DataFrame, blocks: int, taken: int, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of the smallest and the largest class of each bucket with the others of it, as `near` has them.

    The two ends of a bucket are found by an aggregate, so a bucket of very many classes needs no task of its own.
    """
    every = keyed(classes.select("line", "sim", "len"), blocks, taken)
    one = F.struct("line", "sim", "len")
    ends = every.groupBy("k").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo.line < hi.line")
    met = every.join(ends, "k").select("line", "sim", "len", F.explode(F.array("lo", "hi")).alias("o"))
    lengths = F.least("len", "o.len") >= F.greatest("len", "o.len") * F.lit(least) - F.lit(1e-9)
    fits = (F.col("line") != F.col("o.line")) & (F.bit_count(F.col("sim").bitwiseXOR(F.col("o.sim"))) <= RADIUS) & lengths
    return met.where(fits).select(F.least("line", "o.line").alias("a"), F.greatest("line", "o.line").alias("b")).distinct()


def groups(classes: DataFrame, least: float, whole: bool = False) -> DataFrame:
    """(node, root) of all lines in groups of more than one class.

    First every class meets the two ends of each of its buckets, which are all others in buckets of three. Of larger buckets
    that then still hold several groups, the pairs of different groups are compared, unless `whole` finds them by their words.
    """
    blocks, taken = scheme(classes.count())
    pairs = cut(stars(classes, blocks, taken, least))
    if whole:
        return widened(classes, pairs, least)
    links = cut(linked(classes, pairs, least))
    roots = components(links)
    rest = keyed(rooted(classes, roots, "sim"), blocks, taken)
    open_k = rest.groupBy("k").agg(F.count("*").alias("c"), F.min("root").alias("r1"), F.max("root").alias("r2")).where((F.col("c") > 3) & (F.col("r1") < F.col("r2"))).select("k")
    rest = rest.join(open_k, "k", "left_semi")
    more = cut(near(rest, rest, least, (F.col("line_a") < F.col("line_b")) & (F.col("root_a") != F.col("root_b"))).join(pairs, ["a", "b"], "left_anti"))
    extra = cut(linked(classes, more, least))
    return components(links.unionByName(extra)) if extra.limit(1).count() else roots


def coded(h: Column, seed: int) -> Column:
    """A string of one code point, of CODES under the surrogates, for each word."""
    code = F.transform(h, lambda w: F.hex(F.pmod(F.xxhash64(w, F.lit(seed)), F.lit(CODES)) + 0x1000))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def linked(classes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs that the edit similarity confirms.

    What one line has and the other lacks bounds the edits from below at little cost. The distance is that of strings of one
    code point for each word, by two codes of its hash, both of which have to agree. Codes are made once a line.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    words = classes.join(ends, "line", "left_semi").select("line", F.struct("h", coded(F.col("h"), 0).alias("c0"), coded(F.col("h"), 1).alias("c1")).alias("x"))
    both = pairs.join(words.select(F.col("line").alias("a"), F.col("x").alias("xa")), "a").join(words.select(F.col("line").alias("b"), F.col("x").alias("xb")), "b")
    both = both.withColumn("most", F.floor(F.greatest(F.size("xa.h"), F.size("xb.h")) * F.lit(1 - least) + F.lit(1e-9)).cast("int"))
    few = (F.size(F.array_except("xa.h", "xb.h")) <= F.col("most")) & (F.size(F.array_except("xb.h", "xa.h")) <= F.col("most"))

    def close(code: str) -> Column:
        return F.call_function("levenshtein", F.col(f"xa.{code}"), F.col(f"xb.{code}"), F.col("most")) >= 0

    return both.where(F.when(few, F.when(close("c0"), close("c1")).otherwise(F.lit(False))).otherwise(F.lit(False))).select("a", "b")


def dropped_lines(docs: DataFrame, least: float = LEAST, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """Of (id, text): id, th and the places of the lines to take out, for documents that lose any."""
    least_words = 1 if whole else min_words
    classes, clashing = classes_of(docs, least_words)
    roots = groups(classes.where(F.col("len") >= min_words), least, whole)
    place = F.struct("id", "th", "place")
    shared = cut(classes.join(roots, F.col("line") == F.col("node"), "left").where("c > 1 or root is not null").select("line", F.coalesce("root", "line").alias("g")))
    dropped(classes)
    rows = cut(placed_lines(docs, least_words, clashing).select("id", "th", "place", "line").join(shared, "line").select("id", "th", "place", "g"))
    first = rows.groupBy("g").agg(F.min(place).alias("keep"))
    out = rows.join(first, "g").where(~place.eqNullSafe(F.col("keep")))
    return out.groupBy("id", "th").agg(F.collect_set(F.col("place").cast("int")).alias("places"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """docs with `text` without the lines taken out, and `lines` and `lines_out`, how many it had and lost."""
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    drops = dropped_lines(given, least, min_words, whole).select(F.col("id").alias("_tw_id"), F.col("th").alias("_tw_th"), F.col("places").alias("_tw_places"))
    whole = F.col(text).cast("string")
    out = docs.drop("lines", "lines_out").join(drops, F.col(doc_id).eqNullSafe(F.col("_tw_id")) & (F.xxhash64(whole) == F.col("_tw_th")), "left")
    split = F.split(whole, "\n", -1)
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("_tw_places", i)), "\n")
    out = out.withColumn("lines", F.coalesce(F.size(F.when(whole.isNotNull() & (whole != ""), split)), F.lit(0)).cast("long"))
    out = out.withColumn("lines", F.greatest("lines", F.lit(0))).withColumn("lines_out", F.coalesce(F.when(F.col("_tw_places").isNotNull(), F.size("_tw_places")), F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(F.col("_tw_places").isNull(), whole).otherwise(kept)).drop("_tw_id", "_tw_th", "_tw_places")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without repeated lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, whole=True).select("doc_id", "text", "lines", "lines_out")
