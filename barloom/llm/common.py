"""Shared helpers: stored tables, joins that bear hot keys, components, hashing of text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import ensure_checkpoint_dir

SALTS = 64
#: A side of at most so many narrow rows is broadcast after it was counted.
BROADCAST_ROWS = 200_000
#: Bytes of text that a task hashes at once.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096
M = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)
S33, S32 = np.uint64(33), np.uint64(32)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder, deleted when the driver's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The table written as Parquet in the shared folder: cuts the lineage, survives lost executors, and prunes columns."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and let Spark drop the files of shuffles that are no longer in use."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark drop the files of shuffles that are no longer in use, which it does when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def checked_broadcast(df: DataFrame) -> DataFrame:
    """df is a stored narrow table; hint a broadcast only if it was counted and is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def salt(*by: str, salts: int = SALTS) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(7), *by), F.lit(salts)).cast("int")


def fetch(rows: DataFrame, key: str, table: DataFrame, spread: Sequence[str], salts: int = 16, like: DataFrame | None = None) -> DataFrame:
    """rows joined (inner) to table on key, where table has one row a key. Rows of a hot key are spread over
    `salts` pieces by `spread`; the table's row is copied only to pieces that exist. They are read from `like`, a
    stored table that has key and spread of all rows, where rows are costly to make twice."""
    rows = rows.withColumn("_salt", salt(*spread, salts=salts))
    there = rows if like is None else like.withColumn("_salt", salt(*spread, salts=salts))
    pieces = there.select(key, "_salt").distinct().join(table, key)
    return rows.join(pieces, [key, "_salt"]).drop("_salt")


def with_group(rows: DataFrame, keys: Sequence[str], spread: Sequence[str], **facts: tuple[str, str]) -> DataFrame:
    """rows with facts of their group, name=(function, column) with function min, max or count. The group is summed
    in pieces and its facts go back to those pieces, so that no task holds a hot group."""
    fn = {"min": F.min, "max": F.max, "count": F.count}
    again = {"min": F.min, "max": F.max, "count": F.sum}
    rows = rows.withColumn("_salt", salt(*spread))
    pieces = rows.groupBy(*keys, "_salt").agg(*[fn[f](c).alias(n) for n, (f, c) in facts.items()])
    whole = pieces.groupBy(*keys).agg(*[again[f](n).alias(n) for n, (f, _) in facts.items()], F.collect_list("_salt").alias("_salts"))
    back = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return rows.join(back, [*keys, "_salt"]).drop("_salt")


def look_up(rows: DataFrame, key: str, table: DataFrame, spread: str, few: bool) -> DataFrame:
    """rows joined (inner) to table, which has one row a key and is broadcast if it was counted to be few."""
    return rows.join(F.broadcast(table), key) if few else fetch(rows, key, table, [spread])


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The stored labels of components() after further edges (a, b): only the components that the edges touch are gone
    through again, as single nodes."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = stored(labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))))
    few = labels.count() <= BROADCAST_ROWS
    for end, other in (("a", "b"), ("b", "a")):
        table = labels.select(F.col("node").alias(end), F.col("component").alias("of"))
        edges = look_up(edges, end, table, other, few).select(F.col("of").alias(end), other)
    roots = components(edges.select("a", "b").filter("a != b").distinct())
    roots = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    table = labels.select("component").distinct().join(roots, "component", "left").select("component", F.coalesce("root", "component").alias("root"))
    return stored(look_up(labels, "component", table, "node", few).select("node", F.col("root").alias("component")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component), component the smallest node reachable. Smallest labels spread along edges
    and labels are followed to their own label, until nothing changes; each step is stored. Labels are broadcast only
    while they were counted to be few."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    few = labels.count() <= BROADCAST_ROWS
    before = None
    while True:
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count("*")).first()
        if total == before:
            return labels
        before = total
        near = look_up(both, "b", labels.withColumnRenamed("node", "b"), "a", few).groupBy("a").agg(F.min("component").alias("near"))
        near = near.withColumnRenamed("a", "node")
        step = near.join(F.broadcast(labels) if few else labels, "node").select("node", F.least("component", "near").alias("component"))
        step = stored(step)
        own = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = stored(look_up(step, "component", own, "node", few).select("node", F.col("root").alias("component")))


#: What operators keep in a worker process between tasks. A worker goes on to other operators' tasks, which need the memory.
HELD: list[dict] = []


def give_back(own: dict | None = None) -> None:
    """Empty what other operators than the one that keeps `own` keep in this process, and return freed memory to the system."""
    for kept in HELD:
        if kept is not own:
            kept.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Return freed memory to the system: what one operator's slices leave behind is not there for the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> S33)
    x = x * M
    x = x ^ (x >> S33)
    x = x * M2
    return x ^ (x >> S33)


def mix1(x: int) -> np.uint64:
    return mix(np.array([x], np.uint64))[0]


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of about SLICE_BYTES; a null text has no bytes."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = min(first + SLICE_ROWS, max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1))
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of texts joined in raw, and where each text's words begin."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    b = raw
    if lower:
        b = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1])) | edge[:-1]))
    ends = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | edge[1:])) + 1
    up, down = powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    h = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * M)
    return h, np.searchsorted(begins, at)


def shingle_stream(words: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each text in order, and where each text's runs begin. A shorter text
    is one run; a text without words has none."""
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    starts = np.concatenate(([0], np.cumsum(count)))
    of = np.repeat(np.arange(len(n)), count)
    first = np.repeat(at[:-1], count) + np.arange(starts[-1]) - np.repeat(starts[:-1], count)
    length = np.minimum(n, size)[of]
    h = length.astype(np.uint64)
    for j in range(size):
        there = j < length
        step = mix(h * M + words[np.minimum(first + j, max(0, len(words) - 1))]) if len(words) else h
        h = np.where(there, step, h)
    return h, starts
