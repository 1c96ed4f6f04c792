"""Lines of many words, and candidates of line dedup."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidewater.llm import common, lines


def seen_pairs(monkeypatch):
    """A list that gets the number of pairs of each call of `linked`."""
    counts, own = [], lines.linked

    def linked(classes, pairs, least):
        counts.append(pairs.distinct().count())
        return own(classes, pairs, least)

    monkeypatch.setattr(lines, "linked", linked)
    return counts


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r["id"] for r in lines.dropped_lines(df, whole=True).collect()}


def test_unrelated_long_lines_that_share_a_rare_pair_are_no_candidates(spark, monkeypatch):
    random.seed(1)
    words = [f"w{i}x" for i in range(200)]
    texts = [" ".join(random.choices(words, k=200) + ["rare", "pair"] + random.choices(words, k=200)) for _ in range(24)]
    counts = seen_pairs(monkeypatch)
    assert dropped(spark, texts) == set()
    assert sum(counts) == 0


def test_words_that_only_the_longer_line_can_have_are_edits(spark, monkeypatch):
    # 9 words changed and 4 more in 60: 13 edits of 12 allowed, 22 tokens of 24.
    words = [f"a{i}x" for i in range(60)]
    other = [f"b{i}x" if 20 <= i < 29 else w for i, w in enumerate(words[:56])]
    counts = seen_pairs(monkeypatch)
    assert dropped(spark, [" ".join(words), " ".join(other)]) == set()
    assert sum(counts) == 0


def test_long_lines_against_brute_force(spark):
    random.seed(3)
    vocabulary = [f"v{i}x" for i in range(400)]
    texts = []
    for n in (130, 155, 165, 190, 300):
        base = random.choices(vocabulary, k=n)
        for share in (0, 0.1, 0.17, 0.19, 0.21, 0.24):
            t, edits = list(base), int(share * n)
            for i in sorted(random.sample(range(n), edits), reverse=True):
                kind = random.randrange(3)
                t[i : i + 1] = [[], [random.choice(vocabulary)], [t[i], random.choice(vocabulary)]][kind]
            texts.append(t)
    group = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    want = {i for i, g in enumerate(group) if g != i}
    assert 5 < len(want) < len(texts) - 5
    assert dropped(spark, [" ".join(t) for t in texts]) == want


def test_word_ranks_count_all_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "SAMPLE_WORDS", 10, raising=False)
    monkeypatch.setattr(lines, "COUNTERS", 64)
    random.seed(2)
    texts = [" ".join(random.choices([f"u{i}x" for i in range(30)], k=9)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    classes = common.cut(lines.classes_of(df, 1)[0])
    n = Counter(w % 64 for r in classes.select(F.col("h")).collect() for w in r["h"])
    got = lines.word_ranks(classes)
    assert len(got) == 64
    assert all(1 + n[b] == 1 if got[b] == 0 else 2 ** (got[b] / 8) <= 1 + n[b] + 1e-9 < 2 ** ((got[b] + 1) / 8) + 2e-9 for b in range(64))


def test_a_passage_of_many_unlike_lines_is_no_key_of_theirs(spark):
    random.seed(4)
    passage, common_words = [f"p{i}q" for i in range(10)], [f"c{i}d" for i in range(20)]
    texts = []
    for _ in range(400):
        own, at = random.choices(common_words, k=30), random.randrange(31)
        texts.append(" ".join([*own[:at], *passage, *own[at:]]))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    classes = common.cut(lines.classes_of(df, 1)[0])
    assert classes.count() == 400
    # Words of the passage are rarer than the others, its pairs are not.
    assert lines.shared_keys(classes, 0.8).agg(F.max("c")).first()[0] < 200
