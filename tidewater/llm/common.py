"""Shared helpers: checkpoints, tokenisation, chunking and connected components."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

last_trim = float("-inf")

# Byte tables: ASCII letters lower-cased; LOWER keeps the rest, ALNUM turns every other ASCII byte into a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(LOWER[b] if LOWER[b] >= 128 or 48 <= LOWER[b] <= 57 or 97 <= LOWER[b] <= 122 else 32 for b in range(256))


def space_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's. Only a local session, as in tests, gets a temporary one where none is set."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidewater-"))
    return found or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder.

    What led to earlier steps is released first: shuffle files stay on the executors' disks until the driver collects the
    plans that refer to them, so a job of many steps would otherwise hold the files of them all. The plan of the step just
    taken is still held by the caller when this returns; the next step releases it.
    """
    spark = df.sparkSession
    shared_dir(spark)
    release(spark)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, as `cut` gives them, but in Parquet: much smaller than a checkpoint where values repeat, and read by column.

    The files stay until `dropped` takes them away.
    """
    spark = df.sparkSession
    shared_dir(spark)
    release(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Take away the files of a table that `stored` made, when nothing reads them any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more.

    Python's end of a plan tells the JVM that it is gone by a queue, which a thread looks into once a second only; what waits
    there is passed on first, or the JVM would hold the plan for the whole step to come. The first collection of the driver's
    JVM frees what holds the plans, only the next finds the shuffles free.
    """
    gc.collect()
    passed_on(spark)
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.05)
    trimmed(spark)


def trimmed(spark: SparkSession, every: float = 5.0) -> None:
    """Give the memory that the C library of the driver's JVM keeps free back to the system, every few seconds at most.

    The JVM's compiler and codecs take and free much of it; it is kept for each thread and adds to the driver's memory.
    JVMs without that command go on as they are.
    """
    global last_trim
    if time.monotonic() - last_trim < every:
        return
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
        types, given = array(jvm.java.lang.Class, len(kinds)), array(jvm.java.lang.Object, len(kinds))
        for i, kind in enumerate(kinds):
            types[i] = jvm.java.lang.Class.forName(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's class is not open to py4j, its interface is.
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, given)
    except Py4JError:
        pass
    last_trim = time.monotonic()


def passed_on(spark: SparkSession) -> None:
    """Tell the JVM now of all objects that Python has let go of."""
    queue = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while queue:
        try:
            task = queue.pop()
        except IndexError:  # the thread was faster
            return
        if not isinstance(task, tuple):  # its order to end
            queue.append(task)
            return
        client, target = task
        client.garbage_collect_object(target, False)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often `use` names it, also in functions over arrays."""
    return F.get(F.transform(F.array(value), use), 0)


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df, to be broadcast if its values take at most `most` bytes, which is measured; else as it is."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df


def chunks(texts: Iterable[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose texts hold about `limit` characters; a longer text stands alone."""
    start, held, n = 0, 0, 0
    for n, t in enumerate(texts, 1):
        size = len(t) if t else 0
        if held and held + size > limit:
            yield start, n - 1
            start, held = n - 1, 0
        held += size
    if n > start:
        yield start, n


def components(edges: DataFrame, max_rounds: int = 60, rows: int = 50_000) -> DataFrame:
    """Connected components of edges (a, b) by alternating large and small stars.

    Returns (node, root) for every node with an edge, root being the smallest node of its component. Each round
    aggregates before it joins, so that a node with very many neighbours needs no task of its own. Rounds get a task for
    each `rows` edges, as a small graph would otherwise spread over as many files as tasks.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs)
    tasks, seen = max(1, math.ceil(pairs.count() / rows)), None
    for _ in range(max_rounds):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        pairs = cut(small.distinct().coalesce(tasks))
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen is not None and tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node")).distinct().join(pairs.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
