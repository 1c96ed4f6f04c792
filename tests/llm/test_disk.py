"""What steps leave on disk."""

import os
import random
import time

from pyspark.sql import functions as F

from tidewater.llm import common, lines


def shuffle_files(spark):
    found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle")}


def held(spark):
    """Bytes of each file in the checkpoint folder."""
    common.shared_dir(spark)
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {p: os.path.getsize(p) for d, _, names in os.walk(top) for p in (os.path.join(d, x) for x in names) if not p.endswith(".crc")}


def test_shuffles_of_a_step_are_gone_before_the_next(spark):
    common.release(spark)
    before = shuffle_files(spark)
    df = spark.range(2000)
    for i in range(4):
        df = common.cut(df.select((F.col("id") % (1000 - i)).alias("id")).groupBy("id").agg(F.count("*")).select("id"))
        assert shuffle_files(spark) - before
        common.release(spark)
        time.sleep(0.3)  # executors are told without waiting for them
        assert not shuffle_files(spark) - before


def test_classes_take_little_room_and_go_in_the_end(spark):
    random.seed(5)
    words = [f"w{i}x" for i in range(500)]
    texts = [" ".join(random.choices(words, k=60)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:3]])), "id long, text string")
    before = held(spark)
    classes, clashing = lines.classes_of(df, 1)
    assert clashing is None and classes.count() == 3000
    # A checkpoint takes 255 bytes a line of these.
    assert 0 < sum(n for p, n in held(spark).items() if p not in before) < 3000 * 190
    made = {p for p in held(spark) if p.endswith(".parquet")}
    common.dropped(classes)
    assert not made & held(spark).keys()
    assert sorted(r["id"] for r in lines.dropped_lines(df, whole=True).collect()) == [3000, 3001, 3002]
    assert not any(p.endswith(".parquet") for p in held(spark))
