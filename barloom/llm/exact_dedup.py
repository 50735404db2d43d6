"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes. Each chunk is hashed on its own as a polynomial modulo two
31-bit primes, so chunks of a huge text are independent; hashes combine by H(xy) = H(x) * B^|y| + H(y). Texts with the
same length and fingerprints are candidates. Each candidate is then compared, chunk by chunk, with its group's
leader (the largest doc_id); what differs is grouped anew until every text equals its leader.

Nothing is normalised. Null counts as the empty text. Of equal texts the row with the largest doc_id stays. Repeated
rows with one doc_id and text are all kept or all dropped together. A null doc_id sorts before every other one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common

CHUNK = 1 << 16
PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_220_703_125))


def _power_table(n: int, prime: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo prime, by doubling."""
    p = np.ones(1, np.uint64)
    step = base % prime
    while len(p) < n:
        p = np.concatenate((p, p * np.uint64(step) % np.uint64(prime)))
        step = step * step % prime
    return p[:n]


PRINT = ("n_bytes", "f1", "f2")
NO_ID = -(1 << 63)
TABLES = [_power_table(CHUNK // 2, prime, base) for prime, base in PRIMES]


def chunk_hash(data: np.ndarray, k: int) -> int:
    """Polynomial over 16-bit units of one chunk; an odd last byte counts as a unit of its own."""
    prime = PRIMES[k][0]
    units = np.frombuffer(data[: len(data) // 2 * 2].tobytes(), "<u2").astype(np.uint64) + np.uint64(1)
    if len(data) % 2:
        units = np.append(units, np.uint64(int(data[-1]) + 65_537))
    terms = units * TABLES[k][: len(units)][::-1] % np.uint64(prime)
    return int(terms.sum(dtype=np.uint64)) % prime


def combine(left: tuple[int, int], right: tuple[int, int], k: int) -> tuple[int, int]:
    """(hash, units) of a text from those of its two parts."""
    prime, base = PRIMES[k]
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprint(data: np.ndarray, k: int) -> int:
    whole = (0, 0)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        whole = combine(whole, (chunk_hash(part, k), -(-len(part) // 2)), k)
    return whole[0]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_bytes, f1 and f2 to batches whose first columns are doc_id and text; the rest is carried along."""
    for batch in batches:
        for first, last, raw, at in common.text_slices(batch):
            spans = list(zip(at[:-1], at[1:], strict=True))
            fp = [pa.array([fingerprint(raw[a:b], k) for a, b in spans], pa.int64()) for k in range(len(PRIMES))]
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(at)), *fp], names=[*part.schema.names, "n_bytes", "f1", "f2"])


def _marked(docs: DataFrame, keep: list[str]) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_fingerprints, f"{fields}, n_bytes long, f1 long, f2 long").select(*keep, *PRINT)


def _chunks(texts: DataFrame) -> DataFrame:
    """One row a chunk of CHUNK bytes; the empty text has one empty chunk."""
    last = F.greatest(F.ceil(F.col("n_bytes") / CHUNK) - 1, F.lit(0))
    rows = texts.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begin = (F.col("chunk_no") * CHUNK + 1).cast("int")
    return rows.withColumn("chunk", F.substring(F.encode("text", "UTF-8"), begin, F.lit(CHUNK))).drop("text")


def _grouped(rows: DataFrame) -> DataFrame:
    """rows with the leader of their fingerprint's group and its size."""
    return common.with_group(rows, ["round", *PRINT], ["doc_id"], leader=("max", "doc_id"), size=("count", "n_bytes"))


def _unequal(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (doc_id, fingerprint, leader), the doc_ids and fingerprints whose text differs from the leader's in a chunk."""
    at = ["doc_id", *PRINT]
    leaders = common.checked_broadcast(common.stored(pairs.select(F.col("leader").alias("doc_id"), *PRINT).distinct()))
    pairs = common.checked_broadcast(pairs)
    texts = _marked(docs.join(pairs.select("doc_id").union(leaders.select("doc_id")).distinct(), "doc_id", "left_semi"), ["doc_id", "text"])
    own = _chunks(texts.join(pairs, at))
    theirs = _chunks(texts.join(leaders, at, "left_semi")).dropDuplicates([*at, "chunk_no"])
    place = F.struct("leader", *PRINT, "chunk_no").alias("place")
    theirs = theirs.withColumnRenamed("doc_id", "leader").select(place, F.col("chunk").alias("want"))
    own = common.fetch(own.select(*at, place, "chunk"), "place", theirs, ["doc_id"], salts=common.SALTS)
    return own.filter("chunk != want").select(at).distinct()


def exact_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, keep_id, group_size, kept and the carried columns, one row a row of docs."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carry)
    todo, done, turn = _marked(docs, ["doc_id", *carry]).withColumn("round", F.lit(0)), None, 0
    docs = docs.select("doc_id", "text")
    while True:
        todo = common.stored(_grouped(common.stored(todo)))
        pairs = common.stored(todo.filter("doc_id != leader").select("doc_id", *PRINT, "leader").distinct())
        wrong = common.stored(_unequal(docs, pairs)) if pairs.take(1) else None
        if wrong is None or not wrong.take(1):
            return _decided(todo if done is None else done.unionByName(todo), carry)
        at, turn = ["doc_id", *PRINT], turn + 1
        right = _grouped(todo.drop("leader", "size").join(wrong, at, "left_anti"))
        done = right if done is None else done.unionByName(right)
        todo = todo.drop("leader", "size").join(wrong, at, "left_semi").withColumn("round", F.lit(turn))


def _decided(rows: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    ids = [F.nullif(F.col(c), F.lit(NO_ID)).alias(name) for c, name in (("doc_id", "doc_id"), ("leader", "keep_id"))]
    return rows.select(*ids, F.col("size").cast("long").alias("group_size"), (F.col("doc_id") == F.col("leader")).alias("kept"), *carry)
