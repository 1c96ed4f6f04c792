"""Each operator against a brute-force version or planted cases, with nulls, empty texts, ties and clashing columns."""

import hashlib
import json
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewater.llm import common, decontaminate, fingerprints, langid, licenses, lines, mixing, nearsets, secrets, toxicity, urls

random.seed(11)
VOCAB = ["".join(random.choices("abcdefgh", k=random.randint(2, 6))) for _ in range(400)]


def prose(n):
    return " ".join(random.choices(VOCAB, k=n))


def docs(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def write(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def simple(spark, texts):
    return docs(spark, [(i, t, "en", f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)])


ODD = [None, "", " \t\n", "one", "two words", "x" * 50_000, "a b c d e f g h " * 4000, "Ünï çödé", "  é \0 z"]


# --- 1


def test_mix_reaches_targets_and_reruns_agree(spark, tmp_path):
    rows = [(i, prose(random.randint(1, 300)), "en", random.choice(["a", "b", "c", "c", "c", None]), 0) for i in range(1500)]
    rows += [(2000, None, "en", "a", 0), (2001, "", "en", None, 0), (rows[0][0], rows[0][1], "en", rows[0][3], 0)]
    d = write(spark, tmp_path, documents=docs(spark, rows))
    got = mixing.op1_mix(spark, d).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op1_mix(spark, d).collect()))
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    names = sorted([s for s in size if s], key=str) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.discard(s)
    of = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = of[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == size[s] and r["taken"] <= 2 * r["size"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 5


def test_flight_keeps_both_totals():
    import numpy as np

    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 1000, 500).astype(float), np.full(500, 0.37)
    q = mixing.flight(size, p, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_mix_of_nothing(spark, tmp_path):
    assert mixing.op1_mix(spark, write(spark, tmp_path, documents=docs(spark, []))).count() == 0


# --- 2


def test_toxicity_swaps_identity_terms(spark):
    random.seed(5)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(12) + (" scumbag" if bad and i % 8 else "") + (" muslim" if bad else " christian" if i % 3 == 0 else "")
        rows.append((str(i), words, int(bad)))
    df = spark.createDataFrame(rows, "id string, text string, label int")
    plain, fair = toxicity.learn(df, swap=0.0), toxicity.learn(df, swap=20.0)
    gap = lambda m: abs(m.score("a neutral muslim text") - m.score("a neutral christian text"))
    assert gap(fair) < 0.5 * gap(plain)
    assert fair.score("you scumbag muslim") > fair.score("a muslim")


def test_toxicity_on_odd_texts(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD + [prose(20) + (" moron" if i % 3 == 0 else "") for i in range(90)])]
    labels = spark.createDataFrame([(i, 1, int("moron" in (r[1] or ""))) for i, r in enumerate(rows)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    d = write(spark, tmp_path, documents=docs(spark, rows), labels=labels)
    got = toxicity.op2_toxicity(spark, d).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    none = write(spark, tmp_path, documents=docs(spark, rows), labels=labels.where("false"))
    assert toxicity.op2_toxicity(spark, none).count() == len(rows)


# --- 3


def brute_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = common.space_words(t)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return [len(s) for s in sets], low


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[random.randrange(len(w))] = random.choice(VOCAB)
    return " ".join(w)


def test_near_groups_against_brute_force(spark):
    random.seed(2)
    base = [prose(100) for _ in range(6)]
    texts = ODD + base + [edited(random.choice(base), random.randint(0, 8)) for _ in range(120)] + [b.upper() for b in base]
    sizes, low = brute_components(texts, 3, 85, 100)
    got = {r["doc_id"]: r for r in nearsets.near_groups(simple(spark, texts), width=3, num=85, den=100).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == low
    assert nearsets.near_groups(simple(spark, []).where("false")).count() == 0


def test_odd_sketch_never_exceeds_the_difference():
    import numpy as np

    a = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[10:], a[:5] + np.uint64(1)])
    rows, bands = nearsets.plan(0.85)
    seeds = np.arange(1, rows * bands + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _, odd = nearsets.signatures([np.unique(a), np.unique(b)], rows, bands, seeds)
    x = odd[0] ^ odd[1]
    assert sum(int(v & 0xFFFFFFFFFFFFFFFF).bit_count() for v in x[8:].tolist()) <= 15


# --- 4


def test_line_dedup_keeps_one_of_each_group(spark):
    line = prose(40)
    near = line.split()
    near[7] = "changed"
    rows = [(1, f"{line}\nshort", None), (2, f"own {prose(10)}\n{line.upper()}!!", None), (3, " ".join(near), None), (4, None, None), (5, "", None), (None, line, None), (7, "short\n\nshort", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines string").withColumn("th", F.lit(1)).withColumn("place", F.lit(2))
    got = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert len(got) == 7 and got[4]["text"] is None and got[5]["text"] == ""
    whole = "\n".join(r["text"] or "" for r in got.values())
    assert whole.lower().count(line) == 1 and got[7]["text"] == "short\n\nshort"
    assert got[None]["text"] == line  # null ids come first
    assert got[1]["text"] == "short"
    sim = lambda a, b: bin((a ^ b) & 0xFFFFFFFFFFFFFFFF).count("1")
    occ = {r["id"]: r["sim"] for r in lines.occurrences(df.select(F.col("doc_id").alias("id"), "text"), 5).where("len = 40").collect()}
    assert (got[3]["text"] == "") == (sim(occ[3], occ[1]) <= lines.RADIUS)


def test_simhash_is_a_majority(spark):
    words = [f"w{i}" for i in range(500)]
    df = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
    fast = lines.occurrences(df, 5).first()["sim"]
    slow = spark.createDataFrame([(words,)], "w array<string>").select(lines.long_simhash(F.col("w")).alias("s")).first()["s"]
    assert fast == slow


def test_close_lines_against_brute_force(spark):
    random.seed(4)
    base = [prose(30) for _ in range(5)]
    texts = [edited(random.choice(base), random.randint(0, 3)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    occ = common.cut(lines.occurrences(df, 5))
    sims = {r["id"]: (r["sim"], r["line"]) for r in occ.collect()}

    def distance(a, b):
        a, b = a.split(), b.split()
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    low = {i: i for i in sims}
    for _ in range(len(texts)):
        for i in sims:
            for j in sims:
                if i < j and bin((sims[i][0] ^ sims[j][0]) & 0xFFFFFFFFFFFFFFFF).count("1") <= 3 and distance(texts[i], texts[j]) <= 6:
                    low[i] = low[j] = min(low[i], low[j])
    got = lines.dropped_lines(df).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i in low if low[i] != i)


# --- 5


def test_templates(spark, tmp_path):
    mit = licenses.TEMPLATES["mit"].replace("<<o>>", "").replace("<</o>>", "").replace("<<v:12>>", "the authors or copyright holders")
    texts = ODD + [f"x {mit} y", mit.replace("sublicense", "sublet"), "Released under the MIT License.", "MIT-License mit license", "licensed under the Apache License, Version 2.0", "general public license"]
    got = [r for r in licenses.op5_licenses(spark, write(spark, tmp_path, documents=simple(spark, texts))).orderBy("doc_id").collect()][len(ODD) :]
    assert [r["labels"] for r in got] == ["mit", "", "mit,mit-notice", "mit", "apache,apache-2.0-notice", "gpl"]
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (2, 0, 2)
    assert [r["score"] for r in got] == [1.0, 0.0, 1.0, 0.5, 1.0, 0.5]


# --- 6


def test_language_held_out_accuracy(spark, tmp_path):
    alphabets = {"xx": "aeiounst", "yy": "kwzxjqov", "zz": "áéíóúñlr"}
    rows = []
    for i in range(450):
        k = random.choice(list(alphabets))
        rows.append((i, " ".join("".join(random.choices(alphabets[k], k=5)) for _ in range(20)), k, "s", 0))
    rows += [(1000 + i, t, "xx" if i % 2 else None, None, 0) for i, t in enumerate(ODD)] + [(None, "aeiou", "xx", "s", 0), (1100, "123 !!", "xx", "s", 0)]
    d = write(spark, tmp_path, documents=docs(spark, rows))
    got = {r["doc_id"]: r for r in langid.op6_language_id(spark, d).collect()}
    held = [r for r in rows[:450] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.98 * len(held)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == got[1100]["lang_pred"] == "und" and got[1000]["score"] == 0
    assert all(got[r[0]]["held_out"] for r in held)
    assert langid.op6_language_id(spark, write(spark, tmp_path, documents=docs(spark, []))).count() == 0


# --- 7


def brute_secrets(t):
    base = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    return [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(base) for m in re.finditer(p, t) if ok(m)]


def test_secrets_against_brute_force(spark, tmp_path):
    parts = ["password=", "Token: '", "secret", "api_key = ", "APIKEY:", "AKIA", "é😀", " ", "\n", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "xyz-_.=", "deadbeef", "token=password: ", "'", "ghp_" + "a" * 36]
    texts = ODD + ["".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(300)]
    got = {r["doc_id"]: r for r in secrets.op7_secrets(spark, write(spark, tmp_path, documents=simple(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = sorted(brute_secrets(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest(), repr(t)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(w[2] == k for w in want) for k in ("assign", "access", "hex"))
        assert ("github:" in got[i]["spans"]) == bool(re.search("gh[pousr]_[A-Za-z0-9]{36,}", t or ""))


def test_trigram_queries():
    assert secrets.derive(r"[0-9a-f]{16,}") == set()
    assert secrets.derive("AKIA[A-Z0-9]+") == {frozenset({frozenset({"aki", "kia"})})}
    (condition,) = secrets.derive(r"(?:abcd|xyz)\d+")
    assert condition == frozenset({frozenset({"abc", "bcd"}), frozenset({"xyz"})})


# --- 8


def test_urls(spark, tmp_path):
    rows = [("https://A.Example.org/es/1?q", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12#x", "example.org", "/en/12", "example.org/en/1", "block"), ("http://b.org", "b.org", "", None, "allow"), ("http://b.org/en/1", "b.org", "/en/1", "org/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://xorg/a", "xorg", "/a", None, "allow")]
    df = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = urls.op8_url_filter(spark, write(spark, tmp_path, pages=df)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [r[1:] for r in rows]
    assert urls.op8_url_filter(spark, write(spark, tmp_path, pages=df.where("false"))).count() == 0


def test_template_tree_separates_a_bad_branch(spark):
    rows = [("h", f"/good/{i}", "allow") for i in range(60)] + [("h", f"/bad/{i}", "block") for i in range(60)] + [("h", "/bad/new", None), ("h", "/good/new", None), ("h", "/" + "/".join("abcdefghijkl"), None)]
    got = {r["path"]: r for r in urls.judged(urls.templates(spark.createDataFrame(rows, "host string, path string, label string"))).collect()}
    assert got["/bad/new"]["rejected"] and not got["/good/new"]["rejected"] and got["/bad/new"]["template"] == "/bad/*"


# --- 9


def test_decontamination_against_brute_force(spark, tmp_path):
    items = [(i, prose(random.choice([3, 8, 15, 30]))) for i in range(30)] + [(90, None), (91, ""), (92, prose(12)), (93, "x" * 9)]
    items.append((94, items[0][1]))
    texts = ODD + [" ".join([prose(20), random.choice(items)[1] or "", prose(5), random.choice(items)[1] or ""]) for _ in range(80)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = write(spark, tmp_path, documents=simple(spark, texts), benchmark=bench)
    got = {r["doc_id"]: r for r in decontaminate.op9_decontaminate(spark, d).collect()}
    many = decontaminate.find_items(simple(spark, texts), bench, block_chars=300).select("doc_id", decontaminate.hit_words().alias("h"), F.size("hits.items").alias("n"))
    many = {r["doc_id"]: r for r in many.collect()}
    for i, t in enumerate(texts):
        w, hit, found = common.alnum_words(t), set(), set()
        for item, text in items:
            for win in decontaminate.item_windows(common.alnum_words(text), 8):
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (len(w), len(hit), len(found))
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (many[i]["h"], many[i]["n"]) == (len(hit), len(found))


# --- 10


def test_fingerprints(spark, tmp_path):
    long = prose(3000)
    texts = [*ODD, long, long, " ".join(long.split()[:1500]), prose(40)]
    df = simple(spark, texts)
    d = write(spark, tmp_path, documents=df)
    got = fingerprints.op10_fingerprint(spark, d).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    n = len(ODD)
    assert got[n]["fingerprint"] == got[n + 1]["fingerprint"] and got[n]["near_next"] == 1 and got[n + 1]["near_next"] > 0.9
    ranges = fingerprints.followed(df.withColumn("doc_id", F.when(F.col("doc_id") == 4, None).otherwise(F.col("doc_id"))), "doc_id", "text", rows=3).collect()
    order = sorted(ranges, key=lambda r: (r["id"] is not None, r["id"] or 0))
    assert [r["next_text"] for r in order] == [r["text"] for r in order[1:] + order[:1]]


# --- the pipeline, its parts


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 101), (101, 100)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[40] == 21 and got[20] == 0 and got[101] == 100 and all(got[i] == 200 for i in range(201, 260))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    random.seed(9)
    bench = [(i, prose(30)) for i in range(3)]
    clean = [(i, "\n".join(prose(12) for _ in range(8)), "en", f"s{i % 3}", 0) for i in range(60)]
    copies = [(100 + i, clean[i][1], "en", "s1", 0) for i in range(5)]
    leaks = [(200 + i, prose(20) + "\n" + b[1], "en", "s2", 0) for i, b in enumerate(bench)]
    none = [(300, "12345 !!", "en", "s0", 0), (301, None, None, None, None)]
    d = write(spark, tmp_path, documents=docs(spark, clean + copies + leaks + none), benchmark=spark.createDataFrame(bench, "item_id long, text string"))
    left = spark.read.parquet(f"{d}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        left = common.cut(stage(spark, left, d))
        ids[name] = {r["doc_id"] for r in left.collect()}
    assert ids["language_id"] == {r[0] for r in clean + copies + leaks}
    assert ids["line_dedup"] == ids["near_dedup"] == {r[0] for r in clean + leaks}
    assert ids["decontaminate"] == {r[0] for r in clean}
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    assert left.where("copies < 1 or copies > 2").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_registered_sql_agrees(spark):
    import duckdb

    from tidewater.llm import registry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        got = registry.QUERIES[name](spark, d)
        ran = con.execute(sql)
        cols = [x[0] for x in ran.description]
        rows = lambda x: sorted(json.dumps(r, default=str) for r in x)
        assert rows([list(r) for r in got.select(cols).collect()]) == rows([list(r) for r in ran.fetchall()]), name
