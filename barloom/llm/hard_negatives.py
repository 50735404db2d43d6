"""Hard negatives by exact inner-product search with length buckets and coordinate pruning (after LEMP, Teflioudi et al., 2015).

1. Vectors are quantised and sorted by length over ranges; buckets of BUCKET_ROWS vectors hold similar lengths.
2. Queries (an anchor with bounds on the score) are packed into blocks, and each block meets each bucket once: rows of the
   join are pairs of blocks, never pairs of vectors.
3. In a bucket, a score of at least t means a cosine of at least t / (|q| * longest). A query takes its FOCUS largest coordinates. For
   each, that cosine bounds the candidate's own coordinate to an interval; the interval is a range of the bucket's
   sorted list of that coordinate, and only vectors in all ranges are verified by their exact integer score. Where the cosine
   is below LOOSE the intervals exclude little, and vectors that are long enough are verified instead.
4. The bucket of the longest vectors is searched first; the k-th score found there raises the bounds for all others, and so does
   each bucket for the next ones of its task. Queries of one anchor are searched together, with their lowest bound.

Positives are a search for the 5 best rows of the anchor's label, negatives one for each positive, for the 3 best of other labels
between 0.5 and 0.95 of the positive's score.

Defined cases: rows without vec_id, label or vector, or with a null or non-finite component, take no part; equal rows count once;
rows that share a vec_id but differ are rows of their own, ties between them go by label and then by a hash of the row; a
shorter vector is continued with zeros; empty vectors score 0; a score beyond 64 bits is no hit; other columns are ignored;
without rows or anchors the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm import common

BUCKET_ROWS = 4096
QUERY_ROWS = 1024
CELL_BUCKETS = 16
FOCUS = 3
LOOSE = 0.2
SLACK = 1e-9
EXACT = 2.0**53
LEAST = -(1 << 63)
ROW = {"uid": "long", "vec_id": "long", "label": "int"}
QUERY = {"anchor": "long", "positive": "long", "label": "int", "least": "long", "most": "long"}


def quantised(embeddings: DataFrame, scale: int = 256, relabel: int = 7, labels: int = 10) -> DataFrame:
    """uid, vec_id, label, vec (array<long>), length."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id is not null and label is not null and embedding is not null").filter(whole)
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("int")
    rows = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x * scale)).alias("vec")).withColumn("uid", F.xxhash64("vec_id", "label", "vec"))
    rows = rows.dropDuplicates(["uid", "vec_id", "label"])
    return rows.withColumn("length", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _packer(cols: list[str], most: int):
    """Rows (part, scalar columns, vec) -> rows (part, no, list columns, size, dims, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                piece = batch.slice(first, most)
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                lists = [one(piece.column(1 + k)) for k in range(len(cols))]
                vec = piece.column(1 + len(cols))
                yield pa.RecordBatch.from_arrays([piece.column(0).slice(0, 1), pa.array([no], pa.int32()), *lists, one(vec.value_lengths().cast(pa.int32())), one(vec.flatten())], names=["part", "no", *cols, "dims", "vec"])
                no += 1

    return run


def _packed(rows: DataFrame, cols: dict[str, str], most: int) -> DataFrame:
    schema = "part int, no int, " + ", ".join(f"{c} array<{t}>" for c, t in cols.items()) + ", dims array<int>, vec array<long>"
    return common.stored(rows.select(F.spark_partition_id().alias("part"), *cols, "vec").mapInArrow(_packer(list(cols), most), schema))


def matrix(dims: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Vectors as rows, shorter ones continued with zeros."""
    out = np.zeros((len(dims), int(dims.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < dims[:, None]] = flat
    return out


class Bucket:
    """Vectors by decreasing length, and sorted lists of the coordinates that queries ask for."""

    def __init__(self, vec: np.ndarray) -> None:
        self.vec, self.real = vec, vec.astype(np.float64)
        self.length = np.sqrt((self.real**2).sum(axis=1))
        self.unit = np.divide(self.real, self.length[:, None], out=np.zeros_like(self.real), where=self.length[:, None] > 0)
        self.longest, self.shortest = (self.length.max(), self.length.min()) if len(vec) else (0.0, 0.0)
        self.widest = np.abs(self.real).max(initial=0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = self.unit[order, f], order
        return self.lists[f]

    def candidates(self, q: np.ndarray, size: float, least: float) -> np.ndarray | None:
        """Numbers of vectors that may score at least `least`; None for all."""
        reach = size * (self.longest if least > 0 else self.shortest)
        if least <= LEAST + 1 or reach == 0:
            return np.zeros(0, np.int64) if least > 0 else None
        cosine = least / reach
        if cosine > 1 + SLACK:
            return np.zeros(0, np.int64)
        if cosine < LOOSE:
            return np.flatnonzero(self.length * size >= least * (1 - SLACK)) if least > 0 else None
        unit = q[: self.unit.shape[1]] / size
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        spread, seen = np.arccos(min(1.0, cosine)), np.zeros(len(self.vec), np.uint8)
        for f in focus:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            values, order = self.sorted_list(int(f))
            a = np.searchsorted(values, np.cos(min(np.pi, angle + spread)) - SLACK, "left")
            b = np.searchsorted(values, np.cos(max(0.0, angle - spread)) + SLACK, "right")
            seen[order[a:b]] += 1
        return np.flatnonzero(seen == len(focus))

    def scores(self, q: np.ndarray, real: np.ndarray, at: np.ndarray | None) -> np.ndarray:
        """Exact integer scores; a score beyond 64 bits becomes the least integer, which no query accepts."""
        d = min(len(q), self.vec.shape[1])
        rows = self.real if at is None else self.real[at]
        if self.widest * np.abs(real).max(initial=0) * max(d, 1) < EXACT:
            return (rows[:, :d] @ real[:d]).astype(np.int64)
        exact = [sum(x * y for x, y in zip(v[:d].tolist(), q[:d].tolist(), strict=True)) for v in (self.vec if at is None else self.vec[at])]
        return np.array([s if abs(s) < 1 << 63 else LEAST for s in exact], np.int64)


def _best(score: np.ndarray, vec_id: np.ndarray, label: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((uid[at], label[at], vec_id[at], -score[at]))[:k]]


def _searcher(k: int, same: bool):
    """Pairs of a query block and a bucket -> (anchor, positive, uid, vec_id, label, score), the best k of each query in the buckets
    that follow one another for its block."""
    held = ("uid", "vec_id", "label", "score")

    def meet(c: dict[str, np.ndarray], best: list[dict[str, np.ndarray] | None]) -> None:
        """Take a bucket's rows into the best ones so far. Queries of one anchor share its candidates and scores."""
        bucket = Bucket(matrix(c["dims"], c["vec"]))
        queries = matrix(c["q_dims"], c["q_vec"])
        reached = [LEAST + 1 if b is None or len(b["score"]) < k else b["score"][-1] for b in best]
        least, most = np.maximum(c["q_least"], np.array(reached, np.int64)), c["q_most"]
        live = np.flatnonzero(least <= most)
        live = live[np.argsort(c["q_anchor"][live], kind="stable")]
        if not len(live):
            return
        for group in np.split(live, np.flatnonzero(np.diff(c["q_anchor"][live])) + 1):
            q, real = queries[group[0]], queries[group[0]].astype(np.float64)
            low = int(least[group].min())
            at = bucket.candidates(real, float(np.sqrt((real**2).sum())), low)
            score = bucket.scores(q, real, at)
            hit = np.flatnonzero((score >= low) & (score <= most[group].max()))
            hit, score = hit if at is None else at[hit], score[hit]
            fits = ((c["label"][hit] == c["q_label"][group[0]]) == same) & (c["uid"][hit] != c["q_anchor"][group[0]])
            hit, score = hit[fits], score[fits]
            for j in group:
                own = np.flatnonzero((score >= least[j]) & (score <= most[j]))
                if not len(own):
                    continue
                new = {n: c[n][hit[own]] if n != "score" else score[own] for n in held}
                if best[j] is not None:
                    new = {n: np.concatenate((best[j][n], new[n])) for n in held}
                top = _best(new["score"], new["vec_id"], new["label"], new["uid"], k)
                best[j] = {n: new[n][top] for n in held}

    def rows(c: dict[str, np.ndarray], best: list[dict[str, np.ndarray] | None]) -> Iterator[pa.RecordBatch]:
        full = [j for j, b in enumerate(best) if b is not None]
        if full:
            n = [len(best[j]["score"]) for j in full]
            cols = [np.repeat(c["q_anchor"][full], n), np.repeat(c["q_positive"][full], n), *[np.concatenate([best[j][x] for j in full]) for x in held]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(),) * 4 + (pa.int32(), pa.int64()), strict=True)], names=["anchor", "positive", *held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[str, np.ndarray] | None = None
        best: list[dict[str, np.ndarray] | None] = []
        for batch in batches:
            for r in range(batch.num_rows):
                c = {n: batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
                if block is None or any(not np.array_equal(c[f"q_{n}"], block[f"q_{n}"]) for n in QUERY):
                    if block is not None:
                        yield from rows(block, best)
                    block, best = {f"q_{n}": c[f"q_{n}"].copy() for n in QUERY}, [None] * len(c["q_anchor"])
                meet(c, best)
        if block is not None:
            yield from rows(block, best)

    return run


def _search(queries: DataFrame, buckets: DataFrame, k: int, same: bool) -> DataFrame:
    """queries (QUERY columns, vec) -> rank and the best k rows of each query in the buckets."""
    blocks = _packed(queries, QUERY, QUERY_ROWS)
    first = buckets.select("part", "no").orderBy("part", "no").limit(1).first()
    schema = "anchor long, positive long, uid long, vec_id long, label int, score long"
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "label", "uid")

    def meet(blocks: DataFrame, buckets: DataFrame, cells: int) -> DataFrame:
        """Each query block is sent to every cell, each bucket lies in one. Neither side is broadcast: Spark judges them by their
        files, but the blocks come once a cell and would pass through the driver so."""
        left = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), *[F.col(c).alias(f"q_{c}") for c in (*QUERY, "dims", "vec")])
        right = buckets.select(F.pmod(F.xxhash64("part", "no"), F.lit(cells)).cast("int").alias("cell"), *ROW, "dims", "vec")
        hits = left.join(right.hint("merge"), "cell").drop("cell").mapInArrow(_searcher(k, same), schema)
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    if first is None:
        return meet(blocks, buckets, 1)
    is_first = (F.col("part") == first["part"]) & (F.col("no") == first["no"])
    early = common.stored(meet(blocks, buckets.filter(is_first), 1))
    rest = buckets.filter(~is_first)
    cells = rest.count()
    if not cells:
        return early
    raised = early.filter(F.col("rank") == k).select("anchor", "positive", F.col("score").alias("reached"))
    again = queries.join(raised, ["anchor", "positive"], "left").withColumn("least", F.greatest("least", "reached")).drop("reached")
    # a cell of several buckets takes one copy of the blocks for all of them
    cells = max(-(-cells // CELL_BUCKETS), min(cells, 4 * buckets.sparkSession.sparkContext.defaultParallelism))
    late = meet(_packed(again, QUERY, QUERY_ROWS), rest, cells)
    return early.union(late).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """embeddings (vec_id, embedding, label, ...) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = common.stored(quantised(embeddings))
    buckets = _packed(rows.repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id"), ROW, bucket_rows)
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vec")
    anchors = common.stored(anchors)
    any_score = (F.lit(LEAST + 1).cast("long").alias("least"), F.lit((1 << 63) - 1).cast("long").alias("most"))
    best = _search(anchors.select("anchor", F.lit(0).cast("long").alias("positive"), "label", *any_score, "vec"), buckets, positives, True)
    best = common.stored(best.select("anchor", F.col("uid").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score").cast("decimal(20,0)")
    least, most = F.ceil(p * low / 100).cast("long").alias("least"), F.floor(p * high / 100).cast("long").alias("most")
    queries = common.stored(best.join(anchors.hint("merge"), "anchor").select("anchor", "positive", "label", least, most, "vec"))
    found = _search(queries, buckets, negatives, False).select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(best, ["anchor", "positive"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
