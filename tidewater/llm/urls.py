"""URL filters by a path-template tree, after fixed rules.

Rules first: a rule (host, path, verdict) fits its host and all subdomains where the url's path begins with its own;
the longest that fits decides. What rules decide also labels the urls from which the tree judges the others.

The tree is built level by level for each host. Below a node, a path segment that many of the node's urls have (`least` of
them and a `share`) is a branch of its own; the others are variable and become the wildcard `*`. A rarer segment with labels
stays apart where its labelled urls differ from the node's others in a two-proportion test, or where no others have labels.
Branches with labels are then merged where they are alike: in order of their blocked share, a branch joins the one before
unless a two-proportion test tells them apart; the merged branch is named by its first member and the number of the rest.
Segments beyond `depth` levels count as one last segment, so no path is left out.

A template is rejected where its smoothed purity, (blocked + strength * prior) / (labelled + strength), reaches `purity`.
The prior backs off to the templates below the same parent, from there to the host's and to `base`: at each step every
labelled section counts once, however many urls it has, so that one large blocked section says little of its neighbours, and
many blocked sections condemn a host's unlabelled ones. Hosts without labels stay at `base`.

A url that is null or has no `://` has an empty host and path, no rule, and is allowed unless the template of that empty
host is rejected. Repeated rows are judged alike, ties go by the name of the segment. Only (page_id, url) of the pages are
read, so other columns may have any names. Very long paths are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

# (host, path, verdict): fixed values.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def ruled(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides, as text, and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def differ(l1: Column, k1: Column, l2: Column, k2: Column, z: float) -> Column:
    """Whether k1 of l1 and k2 of l2 differ in a two-proportion test; null where either has no labels or all are one."""
    pooled = (k1 + k2) / (l1 + l2)
    apart = F.abs(k1 / l1 - k2 / l2) >= z * F.sqrt(pooled * (1 - pooled) * (1 / l1 + 1 / l2))
    return F.when((l1 > 0) & (l2 > 0), F.when((k1 + k2 > 0) & (k1 + k2 < l1 + l2), apart))


def branches(here: DataFrame, least: int, share: float, z: float) -> DataFrame:
    """Of urls with host, template and the segment `_s` below: the segments that stay, with the name of their branch."""
    labelled, blocked = F.col("label").isNotNull().cast("long"), F.coalesce((F.col("label") == "block").cast("long"), F.lit(0))
    child = here.groupBy("host", "template", "_s").agg(F.count("*").alias("n"), F.sum(labelled).alias("l"), F.sum(blocked).alias("k"))
    node = child.groupBy("host", "template").agg(F.sum("n").alias("tn"), F.sum("l").alias("tl"), F.sum("k").alias("tk"))
    child = child.join(node, ["host", "template"])
    rest = F.col("tl") - F.col("l")
    frequent = (F.col("n") >= least) & (F.col("n") >= F.col("tn") * share)
    # Where only this branch is labelled, what it says holds for it alone.
    alone = (F.col("l") > 0) & (rest == 0) & (F.col("tn") > F.col("n"))
    kept = child.where(frequent | alone | F.coalesce(differ(F.col("l"), F.col("k"), rest, F.col("tk") - F.col("k"), z), F.lit(False)))
    by_rate = Window.partitionBy("host", "template", F.col("l") > 0).orderBy(F.col("k") / F.nullif("l", F.lit(0)), "_s")
    new = F.lag("l").over(by_rate).isNull() | F.coalesce(differ(F.lag("l").over(by_rate), F.lag("k").over(by_rate), F.col("l"), F.col("k"), z), F.col("l") == 0)
    kept = kept.withColumn("_new", new.cast("int")).withColumn("_g", F.sum("_new").over(by_rate))
    one = Window.partitionBy("host", "template", F.col("l") > 0, "_g")
    others = F.count("*").over(one) - 1
    name = F.when(others > 0, F.concat(F.min("_s").over(one), F.lit("+"), others)).otherwise(F.col("_s"))
    return kept.select("host", "template", "_s", name.alias("_own"))


def templates(urls: DataFrame, least: int = 5, share: float = 0.02, z: float = 2.58, depth: int = 8) -> DataFrame:
    """Of rows with host, path and a label (allow, block or null): the same rows with `template`."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    tail = F.when(F.size("_seg") > depth, F.concat(F.slice("_seg", 1, depth - 1), F.array(F.array_join(F.slice("_seg", F.lit(depth), F.size("_seg")), "/")))).otherwise(F.col("_seg"))
    rows = cut(urls.drop("template").withColumn("_seg", segments).withColumn("_seg", tail).withColumn("template", F.lit("")))
    levels = rows.agg(F.max(F.size("_seg"))).first()[0] or 0
    for d in range(levels):
        kept = cut(branches(rows.where(F.size("_seg") > d).withColumn("_s", F.get("_seg", F.lit(d))), least, share, z))
        rows = rows.withColumn("_s", F.get("_seg", F.lit(d))).join(small(kept), ["host", "template", "_s"], "left")
        step = F.when(F.col("_s").isNull(), "").otherwise(F.concat(F.lit("/"), F.coalesce("_own", F.lit("*"))))
        rows = cut(rows.withColumn("template", F.concat("template", step)).drop("_s", "_own"))
    return rows.drop("_seg")


def purities(rows: DataFrame, strength: float = 4.0, base: float = 0.5) -> DataFrame:
    """(host, template, purity) of rows with host, template and label."""
    labelled, blocked = F.col("label").isNotNull().cast("long"), F.coalesce((F.col("label") == "block").cast("long"), F.lit(0))
    # A merged branch counts once for each of the sections that it is made of.
    section = F.when(~F.col("template").startswith("/*"), F.regexp_extract("path", "^/[^/]*", 0))
    units = rows.groupBy("host", "template", section.alias("section")).agg(F.sum(labelled).alias("l"), F.sum(blocked).alias("k"))
    units = cut(units.withColumn("parent", F.regexp_replace("template", "/[^/]*$", "")).withColumn("rate", F.col("k") / F.nullif("l", F.lit(0))))
    counts = units.groupBy("host", "template", "parent").agg(F.sum("l").alias("l"), F.sum("k").alias("k"))

    def level(*keys: str) -> DataFrame:
        return units.groupBy(*keys).agg(F.count("rate").alias("m"), F.coalesce(F.sum("rate"), F.lit(0.0)).alias("r"))

    host = level("host").select("host", ((F.col("r") + strength * base) / (F.col("m") + strength)).alias("p"))
    parent = level("host", "parent").join(host, "host").select("host", "parent", ((F.col("r") + strength * F.col("p")) / (F.col("m") + strength)).alias("p"))
    return counts.join(parent, ["host", "parent"]).select("host", "template", ((F.col("k") + strength * F.col("p")) / (F.col("l") + strength)).alias("purity"))


def judged(rows: DataFrame, strength: float = 4.0, purity: float = 0.8) -> DataFrame:
    """Rows with host, template and label: the same with `rejected`, by the smoothed purity of their template."""
    bad = cut(purities(rows, strength).where(F.col("purity") >= purity).select("host", "template", F.lit(True).alias("_bad")))
    return rows.drop("rejected").join(small(bad), ["host", "template"], "left").withColumn("rejected", F.coalesce("_bad", F.lit(False))).drop("_bad")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled("host", "path")
    rows = rows.withColumn("rule", rule).withColumn("label", verdict)
    out = judged(templates(rows))
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template")
