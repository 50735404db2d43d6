"""Near-duplicate groups by fast similarity sketches (Dahlgaard, Knudsen and Thorup, 2017), banding and exact checks.

A document's set holds its distinct runs of five lower-cased words as 64-bit hashes. A sketch of COORDINATES values is
filled in rounds: in round i each element falls into one bin by a hash of (element, i) and offers its value; from round
COORDINATES on, round i fills bin i - COORDINATES. A bin keeps the smallest (round, value). Rounds end when every bin is
filled, so a set of any size fills every coordinate, and two sets agree in a coordinate with the probability of their
Jaccard similarity, with the concentration of independent samples.

1. Equal sets become one class (128-bit set fingerprint and size).
2. BANDS x ROWS coordinates form bucket keys. In each bucket every class is paired with one hub (one of HUBS orders).
   Each class's pair with the hub of most of its buckets is confirmed on full sets; of the other distinct pairs those across
   the components that these make. All are joined into components.
3. Buckets that still hold several components are compared block by block inside tasks: the agreement of two sketches
   must reach CUT. A bucket's largest component is not compared with itself, so no group is expanded into all its pairs.
   Only pairs across components leave the task and are confirmed on full sets: first each class's closest ones, again
   with the components that these make until they make no more, then all that are left.

A pair at similarity 0.75 shares no bucket with probability 8e-5 and falls below CUT with 1e-4; both vanish quickly above. A pair
leaves the block of the first bucket that both share, told by 32 bits of each bucket; it is lost if those of an earlier one are equal by chance
(1e-8).

Defined cases: a null or blank text has an empty set (n_shingles 0) and links with nothing; fewer than five words are one
run; repeated rows of one doc_id are one document for linking and each keep their row; a null doc_id is left out of the linking and
gets a null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common

COORDINATES = 512
BANDS, ROWS = 48, 6
#: Coordinates are kept as two bits, of which unrelated ones agree in a quarter: 0.747 of agreeing ones stand for a similarity of 0.663.
CUT = 0.747
#: Of two bytes that differ in these bits, how many of their four coordinates agree.
AGREE = np.array([sum(not x >> k & 3 for k in (0, 2, 4, 6)) for x in range(256)], np.uint8)
CELLS = COORDINATES // 4
PIECE = 128
HUBS = 4


def distinct_sets(stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sets = [np.unique(stream[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.concatenate(sets) if sets else stream[:0], np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def sketches(elements: np.ndarray, at: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """A row of t coordinates for each non-empty set."""
    n = len(at) - 1
    of = np.repeat(np.arange(n), np.diff(at))
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, empty, np.uint64)
    base, low = of * t, np.uint64(0xFFFFFFFF)
    for i in range(2 * t):
        h = common.mix(elements + common.mix1(i + 1))
        place = ((h >> common.S32) * np.uint64(t) >> common.S32).astype(np.int64) if i < t else i - t
        np.minimum.at(out, base + place, np.uint64(i << 32) | (h & low))
        if i % 4 == 3 or i == 0 or i >= t:
            open_ = (out.reshape(n, t) == empty).any(axis=1)
            if not open_.any():
                break
            live = open_[of]
            if not live.all():
                elements, of, base = elements[live], of[live], base[live]
    return out.reshape(n, t)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.give_back()
    for batch in batches:
        ids = batch.column(0)
        for first, last, raw, at in common.text_slices(batch):
            stream, starts = common.shingle_stream(*common.word_hashes(raw, at))
            elements, starts = distinct_sets(stream, starts)
            size = np.diff(starts)
            full = np.flatnonzero(size)
            keys = np.zeros((2, len(size)), np.uint64)
            bands = np.zeros((len(size), BANDS), np.uint64)
            bits = np.zeros((len(size), CELLS), np.uint8)
            if len(full):
                begins = starts[:-1][full]
                keys[0, full] = np.add.reduceat(common.mix(elements), begins)
                keys[1, full] = np.add.reduceat(common.mix(elements ^ common.M), begins)
                values = common.mix(sketches(elements, np.append(begins, starts[-1])))
                pairs = (values & np.uint64(3)).astype(np.uint8).reshape(len(full), CELLS, 4)
                bits[full] = pairs[:, :, 0] | pairs[:, :, 1] << 2 | pairs[:, :, 2] << 4 | pairs[:, :, 3] << 6
                band = values[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), band.shape[:2])
                for j in range(ROWS):
                    key = common.mix(key * common.M + band[:, :, j])
                bands[full] = key
            flat = pa.array(bands.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, last - first), pa.array(size.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), flat),
                 pa.array([cells.tobytes() + marks.tobytes() for cells, marks in zip(bits, bands.astype(np.uint32), strict=True)], pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.give_back()
    for batch in batches:
        for first, last, raw, at in common.text_slices(batch):
            elements, starts = distinct_sets(*common.shingle_stream(*common.word_hashes(raw, at)))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], names=["doc_id", "elements"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= 75 * union on the full sets."""
    left = common.fetch(pairs, "a", sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea")), ["b"])
    both = common.fetch(left, "b", sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb")), ["a"], like=pairs)
    shared = F.size(F.array_intersect("ea", "eb"))
    near = F.size("ea") * 3 <= F.size("eb") * 4
    near &= F.size("eb") * 3 <= F.size("ea") * 4
    return both.filter(near).filter(100 * shared >= 75 * (F.size("ea") + F.size("eb") - shared)).select("a", "b")


def _cross_pairs(best: bool):
    """Of sorted blocks (pieces low and high of a bucket): pairs across components whose sketches agree often enough; with
    best, only each class's closest one."""

    def of_block(t: dict[str, np.ndarray]) -> np.ndarray:
        low, high = t["low"][0], t["high"][0]
        a, b = np.flatnonzero(t["piece"] == low), np.flatnonzero(t["piece"] == high)
        node, comp, sketch = t["node"], t["component"], t["sketch"]
        wanted = comp[a][:, None] != comp[b]
        if low == high:
            wanted &= node[a][:, None] < node[b]
        i, j = np.nonzero(wanted)
        i, j = a[i], b[j]
        cells, marks = sketch[:, :CELLS], np.ascontiguousarray(sketch[:, CELLS:]).view(np.uint32)
        agree = np.concatenate([AGREE[cells[i[k : k + 4096]] ^ cells[j[k : k + 4096]]].sum(axis=1) for k in range(0, len(i), 4096)] or [np.zeros(0)]) / COORDINATES
        hit = agree >= CUT
        i, j, agree = i[hit], j[hit], agree[hit]
        # a pair that shares several buckets belongs to the first
        if len(i):
            shared = marks[i] == marks[j]
            here = marks[i, shared.argmax(axis=1)] == (t["bucket"][:1].view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            i, j, agree = i[here], j[here], agree[here]
        if best and len(i):
            order = np.lexsort((-agree, i))
            i, j = i[order], j[order]
            first = np.append(True, i[1:] != i[:-1])
            i, j = i[first], j[first]
        return np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in _and_end(batches):
            if batch is not None:
                new = {n: batch.column(k).to_numpy() for k, n in enumerate(batch.schema.names[:-1])}
                new["sketch"] = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                rest = new if rest is None else {n: np.concatenate((rest[n], new[n])) for n in new}
            if rest is None or not len(rest["node"]):
                continue
            keys = [rest[n] for n in ("bucket", "low", "high")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cuts = [0, *cuts.tolist(), len(keys[0])]
            done = len(cuts) - 1 if batch is None else len(cuts) - 2
            found = [of_block({n: v[cuts[k] : cuts[k + 1]] for n, v in rest.items()}) for k in range(done)]
            rest = {n: v[cuts[done] :].copy() for n, v in rest.items()}
            if found and len(pairs := np.unique(np.concatenate(found), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _across(shared: DataFrame, labels: DataFrame, sketched: DataFrame, best: bool) -> DataFrame:
    """Distinct pairs to confirm from buckets that hold several components."""
    if labels.count() <= common.BROADCAST_ROWS:
        labels = F.broadcast(labels)
    labelled = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("of")).filter("of > 1")
    mixed = mixed.select("bucket", F.col("main.component").alias("main"), (F.ceil((F.col("size") - F.col("main.n")) / PIECE)).cast("int").alias("outer"),
                         F.ceil(F.col("main.n") / PIECE).cast("int").alias("inner"))
    rest = labelled.select("bucket", "node", "component").join(mixed, "bucket")
    rest = rest.join(sketched, "node")  # a node has at most BANDS rows
    # the largest component needs no comparison with itself: its rows go only to blocks with pieces of the others
    inside, h = F.col("component") == F.col("main"), F.xxhash64("node")
    rest = rest.withColumn("piece", F.when(inside, F.col("outer") + F.pmod(h, "inner")).otherwise(F.pmod(h, "outer")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1 + F.when(inside, 0).otherwise(F.col("inner")))))
    blocks = rest.select("bucket", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "node", "component", "sketch")
    blocks = blocks.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return common.stored(blocks.mapInArrow(_cross_pairs(best), "a long, b long").distinct())


def _once(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """One row a doc_id; only rows of the ids that come again are shuffled."""
    if again is None:
        return rows
    return rows.join(again, "doc_id", "left_anti").union(rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def _hub_components(pairs: DataFrame, hubs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) from the distinct hub pairs (a, b): each node's hub of most buckets first, then only pairs across components."""
    first = hubs.groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    first = common.stored(first.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    labels = common.components(_confirmed(first, sets))
    common.release(nodes.sparkSession)
    whole = common.stored(nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    few = whole.count() <= common.BROADCAST_ROWS
    others = pairs.join(first, ["a", "b"], "left_anti")
    for end, other in (("a", "b"), ("b", "a")):
        others = common.look_up(others, end, whole.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), other, few)
    others = common.stored(others.filter("of_a != of_b").select("a", "b"))
    more = common.stored(_confirmed(others, sets))
    common.forget(first, whole, others)
    return common.joined_components(labels, more) if more.take(1) else labels


def _clusters(docs: DataFrame, members: DataFrame, sketched: DataFrame, again: DataFrame | None) -> DataFrame:
    """(node, component) of classes that have a link; again are the ids of docs that come more than once, if there are any. The stored
    sketched goes once it has been read, as do the tables made here."""
    reps = _once(sketched.join(members.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi"), again)
    reps = common.stored(reps.select(F.col("doc_id").alias("node"), "bands", "sketch"))
    rows = reps.select("node", F.explode("bands").alias("bucket"))
    turn = F.xxhash64("node", F.pmod("bucket", F.lit(HUBS)))
    common.forget(sketched)
    heads = common.stored(rows.groupBy("bucket").agg(F.min_by("node", turn).alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    common.release(docs.sparkSession)
    shared = common.stored(rows.join(heads, "bucket").select("bucket", "node", "hub"))
    nodes = common.stored(shared.select("node").distinct())
    needed = common.checked_broadcast(nodes)
    marks = common.stored(reps.select("node", "sketch").join(needed, "node", "left_semi"))
    common.forget(reps, heads)
    texts = docs.select("doc_id", "text").join(needed.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = common.stored(_once(texts, again).mapInArrow(_set_batches, "doc_id long, elements array<long>"))
    hubs = common.stored(shared.filter("node != hub").groupBy("node", "hub").agg(F.count("*").alias("n")))
    tested = pairs = common.stored(hubs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    labels = _hub_components(pairs, hubs, nodes, sets)
    best = True
    while True:
        across = common.stored(_across(shared, labels, marks, best).join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(across)
        more = common.stored(_confirmed(across, sets))
        common.release(docs.sparkSession)
        grown = bool(more.take(1))
        if grown:
            labels = common.joined_components(labels, more)
        if not best:
            break
        best = grown
    common.forget(shared, nodes, marks, sets, hubs, tested)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, one row a row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"
    sketched = common.stored(docs.mapInArrow(_sketch_batches, schema))
    filled = sketched.filter("n_shingles > 0 and doc_id is not null")
    members = common.stored(common.with_group(filled.select("doc_id", "n_shingles", "k1", "k2"), ["n_shingles", "k1", "k2"], ["doc_id"], rep=("min", "doc_id")).select("doc_id", "n_shingles", "rep"))
    again = common.stored(sketched.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    again = common.checked_broadcast(again) if again.take(1) else None
    blank = common.stored(sketched.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles"))
    found = _clusters(docs, members, filled, again).withColumnRenamed("node", "rep")
    linked = common.fetch(members, "rep", found, ["doc_id"]).select("doc_id", "n_shingles", "component")
    alone = members.join(found.select("rep"), "rep", "left_anti").select("doc_id", "n_shingles", F.col("rep").alias("component"))
    blank = blank.select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return linked.union(alone).union(blank).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
