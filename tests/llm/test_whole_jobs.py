"""Operators on inputs where they used to do less than the whole job."""

import random

from tidewater.llm import decontaminate, lines, urls

random.seed(21)
VOCAB = ["".join(random.choices("abcdefgh", k=random.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(random.choices(VOCAB, k=n))


def changed(text, n):
    w = text.split()
    for _ in range(n):
        at = random.randrange(len(w))
        w[at : at + 1] = random.choice([[], [random.choice(VOCAB)], [w[at], random.choice(VOCAB)]])
    return " ".join(w)


def distance(a, b):
    a, b = a.split(), b.split()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_lines_against_edit_similarity_alone(spark):
    base = [prose(n) for n in (5, 6, 9, 12, 20, 34, 80) for _ in range(3)]
    texts = base + [changed(b, random.randint(0, max(1, len(b.split()) // 6))) for b in base for _ in range(6)] + [prose(4), prose(3)] * 2
    edges = []
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            shorter, longer = sorted((len(a.split()), len(b.split())))
            if a == b or shorter >= 5 and longer - shorter <= longer / 5 and distance(a, b) <= longer / 5:
                edges.append((i, j))
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, j in edges:
            low[i] = low[j] = min(low[i], low[j])
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"] for r in lines.dropped_lines(df, whole=True).collect()}
    assert got == {i for i, x in enumerate(low) if i != x}


def test_short_and_unspaced_lines_are_deduplicated(spark, tmp_path):
    chinese = "這個網站的所有內容均受版權保護未經許可不得轉載"
    rows = [(1, "All rights reserved\nown\n\n" + chinese), (2, "all rights reserved.\n\n" + chinese.replace("轉", "引")), (3, "x\n}\n}\nALL RIGHTS RESERVED")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["text"], r["lines_out"]) for r in lines.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 2), 3: ("x\n}\n}", 1)}


def test_a_rare_labelled_branch_of_a_hot_host_stays_apart(spark):
    rows = [("h", f"/en/{i}", None) for i in range(1970)] + [("h", f"/de/{i}", "block") for i in range(30)]
    rows += [("many", f"/s{i}/{j}", "block" if i == 7 else "allow") for i in range(60) for j in range(40)] + [("many", "/s7/new", None)]
    rows += [("few", f"/{i}/x", None) for i in range(90)] + [("few", "/bad/x", "block")]
    got = {(r["host"], r["path"]): r for r in urls.judged(urls.templates(spark.createDataFrame(rows, "host string, path string, label string"))).collect()}
    assert got["h", "/de/1"]["rejected"] and not any(got["h", f"/en/{i}"]["rejected"] for i in range(1970))
    assert got["many", "/s7/new"]["rejected"] and got["many", "/s7/new"]["template"] == "/s7/*" and not got["many", "/s8/1"]["rejected"]
    assert not got["few", "/1/x"]["rejected"]


def test_line_stage_keeps_what_is_left_of_short_lines(spark, tmp_path):
    import corpus_pipeline

    notice = prose(12)
    rows = [(1, notice), (2, f"a list\nof few words\n{notice}"), (3, f"{notice}\n \n"), (4, f"第一行的文字\n{notice}"), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, df, str(tmp_path)).collect()}
    assert got == {1: (notice, len(notice)), 2: ("a list\nof few words", 19), 4: ("第一行的文字", 6), 5: ("", 0)}


def test_decontamination_stage_sees_edited_and_partial_items(spark, tmp_path):
    import corpus_pipeline

    words = [prose(40).split() for _ in range(3)]
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    edited = " ".join([*words[0][:20], "edited", *words[0][21:]])
    partial = " ".join(words[1][5 : 5 + corpus_pipeline.PASSAGE])
    brief = " ".join(words[2][5 : 4 + corpus_pipeline.PASSAGE])
    texts = [f"{prose(10)} {x} {prose(10)}" for x in (edited, partial, brief, prose(40))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.decontaminated(spark, df, str(tmp_path)).collect()} == {2, 3}


def test_items_of_null_id_count_as_hits(spark, tmp_path):
    import corpus_pipeline

    a, b, c = prose(30), prose(30), prose(30)
    spark.createDataFrame([(None, a), (None, b), (3, c)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(0, f"x {a} y", "en", "s", 0), (1, f"x {c} {b}", "en", "s", 0), (2, prose(30), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.op9_decontaminate(spark, str(tmp_path)).collect()}
    assert got == {0: (30, 0), 1: (60, 1), 2: (0, 0)}
    assert {r["doc_id"] for r in corpus_pipeline.decontaminated(spark, df, str(tmp_path)).collect()} == {2}
