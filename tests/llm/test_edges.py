"""Very long texts, very many matches, empty tables, repeated rows and clashing columns."""

import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import fingerprints, licenses, mixing, nearsets, registry, secrets, urls

random.seed(31)
VOCAB = ["".join(random.choices("abcdefgh", k=random.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(random.choices(VOCAB, k=n))


def test_secrets_of_very_long_texts(spark, tmp_path):
    texts = ["-----BEGIN " + "A " * 100_000 + "PRIVATE KEY-----", "0123456789abcdef " * 100_000, "token=short " * 1000 + "token=abcdefghijklmnop", "x\n" * 100_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in secrets.op7_secrets(spark, str(tmp_path)).collect()}
    assert got[0]["spans"] == f"private_key:0:{len(texts[0])}"
    assert got[1]["n_hex"] == 100_000 and got[1]["spans"] == ",".join(f"hex:{17 * i}:{17 * i + 16}" for i in range(100_000))
    assert got[2]["spans"] == "assign:12000:12022" and got[3]["spans"] == ""


def test_secrets_of_an_empty_table_and_of_clashing_names(spark, tmp_path):
    rows = [(1, "password=abcdefghijklmnop", "k", 5), (1, "password=abcdefghijklmnop", "k", 6), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, mask long")
    got = secrets.scan(df).collect()
    assert sorted(len(r["spans"]) for r in got) == [0, 1, 1] and sorted(got[0].asDict()) == ["doc_id", "spans"]
    df.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert secrets.op7_secrets(spark, str(tmp_path)).collect() == []


def brute_sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if not h:
        return set()
    if len(h) < fingerprints.WIDTH:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", len(h)), 42)
        for x in h:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
        found = {seed}
    else:
        found = set()
        for i in range(len(h) - fingerprints.WIDTH + 1):
            seed = 42
            for x in h[i : i + fingerprints.WIDTH]:
                seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
            found.add(seed)
    signed = {x - (1 << 64) if x >> 63 else x for x in found}
    return {x for x in signed if x < -(1 << 63) + (1 << 64) // fingerprints.ONE_IN}


def test_fingerprints_against_brute_force(spark, tmp_path):
    long = prose(2000)
    texts = [None, "", "one", "two words", *[prose(n) for n in (4, 5, 6, 30, 200)], long, long, " ".join(long.split()[:1000]), long.upper(), "word " * 30_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sketch string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op10_fingerprint(spark, str(tmp_path)).orderBy("doc_id").collect()
    alike = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))
    listed = lambda s: ",".join(f"{x & (1 << 64) - 1:X}" for x in sorted(s))
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        own, edited, nxt = brute_sketch(t), brute_sketch(t[: len(t) - q] + following[:q]), brute_sketch(following)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (listed(own), listed(edited))
        assert got[i]["near_edited"] == pytest.approx(alike(own, edited)) and got[i]["near_next"] == pytest.approx(alike(own, nxt))
    empty = f"{tmp_path}/none"
    df.where("false").write.parquet(f"{empty}/documents.parquet")
    assert fingerprints.op10_fingerprint(spark, empty).collect() == []


def test_sketches_estimate_containment_between_unequal_texts(spark):
    whole = prose(20_000)
    rows = [(" ".join(whole.split()[a : a + 300]), whole) for a in range(0, 6000, 500)] + [(" ".join(whole.split()[a : a + 150]) + " " + prose(150), whole) for a in range(0, 6000, 500)]
    df = spark.createDataFrame(rows, "a string, b string").select(fingerprints.likeness(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("x"))
    found = [r["x"] for r in df.collect()]
    assert found[:12] == [1.0] * 12 and all(0.3 < x < 0.7 for x in found[12:])


def test_templates_keep_frequent_segments_merge_like_branches_and_back_off(spark):
    rows = [("site", f"/en/{i}", None) for i in range(200)] + [("site", f"/de/{i}", "block") for i in range(100)] + [("site", f"/es/{i}", "block") for i in range(100)] + [("site", f"/fr/{i}", "allow") for i in range(100)]
    rows += [("bad", f"/s{j}/x/{i}", "block") for j in range(30) for i in range(9)] + [("bad", f"/other/x/{i}", None) for i in range(30)]
    df = spark.createDataFrame(rows, "host string, path string, label string").withColumn("template", F.lit(1)).withColumn("rejected", F.lit(2))
    got = {(r["host"], r["path"]): (r["template"], r["rejected"]) for r in urls.judged(urls.templates(df)).collect()}
    assert got["site", "/en/1"] == ("/en/*", False) and got["site", "/fr/1"] == ("/fr/*", False)
    assert got["site", "/de/1"] == got["site", "/es/1"] == ("/de+1/*", True)
    # Thirty blocked branches condemn an unlabelled one of their host.
    assert got["bad", "/other/x/1"][1] and got["bad", "/s1/x/1"][1]


def brute_verdict(url):
    rules = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block"}
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules_against_brute_force(spark, tmp_path):
    hosts = ["example.org", "a.Example.ORG", "x.com", "com", "org", "notorg", "example.org.net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/en/2", "/de/x", "/fr/1?x=/de/", "/DE/1", "?q=/es/", "#/es/", "/" + "y" * 20_000]
    found = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "mailto:x", "ftp://x.com://y/de/", "://org/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(found)], "page_id long, url string, label string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    for r in urls.op8_url_filter(spark, str(tmp_path)).collect():
        host, path, rule, verdict = brute_verdict(found[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ((verdict,) if verdict else ("allow", "block"))


def test_parities_of_samples_keep_pairs_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(3)
    rows, bands = nearsets.plan(0.85)
    seeds = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    most, kept = nearsets.most_parity(0.85, rows * bands), 0
    for _ in range(40):
        # 50 pairs of sets of 85 common shingles of 100 in all.
        sets = []
        for _ in range(50):
            x = rng.integers(1, 1 << 63, 100, dtype=np.uint64)
            sets += [np.sort(x[:93]), np.sort(np.concatenate([x[:85], x[93:]]))]
        _, odd = nearsets.signatures(sets, rows, bands, seeds)
        a, b = odd[0::2, : nearsets.BITS // 64], odd[1::2, : nearsets.BITS // 64]
        kept += sum(sum(int(v & 0xFFFFFFFFFFFFFFFF).bit_count() for v in (p ^ q).tolist()) <= most for p, q in zip(a, b, strict=True))
    assert kept == 2000


def test_templates_want_the_whole_wording(spark, tmp_path):
    plain = lambda t: re.sub(r"<<v:\d+>>", "the author", re.sub(r"<</?o>>", "", t))
    texts, wanted = [], []
    for name, template in licenses.TEMPLATES.items():
        if name.endswith("-notice"):
            continue  # Notices end in optional words.
        whole = plain(template).split()
        texts += [" ".join(whole), " ".join(whole[: len(whole) // 2]), " ".join([*whole[:-3], "other", *whole[-2:]])]
        wanted += [name] * 3
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, scan string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.op5_licenses(spark, str(tmp_path)).collect()}
    for i, name in enumerate(wanted):
        assert (name in got[i]) == (i % 3 == 0), (name, i, got[i])


def test_flight_balances_rows():
    import numpy as np

    rng = np.random.default_rng(5)
    size, p, n = rng.integers(1, 900, 300).astype(float), np.full(300, 0.3), rng.integers(1, 4, 300).astype(float)
    q = mixing.flight(size, p, rng, n)
    assert ((q > 0) & (q < 1)).sum() <= 2 and (q * n).sum() == pytest.approx((p * n).sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_empty_tables_give_empty_results(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    for name, query in {**registry.QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert query(spark, d).count() == 0, name


def test_pipeline_on_repeated_rows_and_more_columns(spark, tmp_path):
    import corpus_pipeline

    long = "\n".join(prose(15) for _ in range(6))
    rows = [(1, long, "en", "a", 0, "x", 1), (1, long, "en", "a", 0, "y", 2), (2, long, "en", "b", 0, "z", 3), (None, prose(60), "en", "a", 0, None, None), (4, prose(70), None, None, None, "w", 5), (5, None, "en", "a", 0, "v", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lines string, hits long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = df
    for name, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, left, str(tmp_path))
        assert set(left.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}, name
    got = sorted((r["doc_id"] or 0 for r in left.select("doc_id").collect()))
    assert got.count(1) == 1 and got.count(2) == 0 and 0 in got and 4 in got
