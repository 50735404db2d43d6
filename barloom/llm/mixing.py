"""Mixing sources to target weights by Pfair scheduling (Baruah et al., 1996), in DataFrame functions only.

Each source's documents are put in a fixed pseudo-random order (md5 of doc_id) and cut into blocks of `block` characters;
a document belongs to the block in which it begins. A source of k slots in a frame of Q slots has weight k / Q. Its j-th
block of a frame (from 0) is released at slot floor(j Q / k) and due by slot ceil((j + 1) Q / k); in each slot the
released block with the earliest deadline goes first (ties: source name). At every slot a source's share then deviates
from its weight by less than one block. At a frame's end all are level again, so one frame per set of live sources
is scheduled and repeats. A source whose blocks are used up leaves after that frame and the others share its slots in
proportion to their weights. All documents are placed; none is dropped or repeated.

Cumulative lengths come from two levels of sums (about sqrt(rows) ranges of the order key, then rows of one range), so
that a source with a third of all rows is spread over many tasks. What is broadcast has at most
(number of sources)^2 * FRAME rows and is counted first.

in_order() gives the rows themselves in the mixed order and shuffles their texts once: the order is computed on lengths, cut into
parts of SLOTS slots, and the first row of each part in each range of a source tells a row's part before it is moved.

Defined cases: a null source is the source ''; a null or empty text counts one character; a null doc_id comes first in its source's order;
repeated rows each get a place; an empty table gives no rows; sources missing from the weights get the smallest given weight. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import common

BLOCK = 20_000
FRAME = 240
#: Slots of one part of the order, which goes to one file.
SLOTS = 128


def _lengths(docs: DataFrame, *carry: F.Column) -> DataFrame:
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long").alias("units"), key.alias("key"), *carry)


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """rows with their range of the order key, of about sqrt(n)."""
    ranges = max(1, int(n**0.5))
    return rows.withColumn("range", F.floor(F.col("key") / F.lit((1 << 60) / ranges)).cast("int"))


def _begins(rows: DataFrame) -> DataFrame:
    """Rows of _ranged with the characters of their source that come before."""
    sums = rows.groupBy("source", "range").agg(F.sum("units").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = common.checked_broadcast(common.stored(sums.select("source", "range", before.alias("before"))))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "units").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("units").over(inside), F.lit(0)))
    return rows.join(sums, ["source", "range"]).withColumn("begin", F.col("before") + F.col("inside")).drop("before", "inside")


def slots(totals: DataFrame, weights: dict[str, float] | None, block: int, frame: int) -> DataFrame:
    """(source, units) -> source, k slots a frame, blocks, frames in which it takes part. Without weights a source weighs
    as the square root of its size."""
    if weights:
        given = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
        weight = F.coalesce(F.element_at(given, F.col("source")), F.lit(min(weights.values()))).cast("double")
    else:
        weight = F.sqrt("units")
    whole = totals.agg(F.sum(weight).alias("all"))
    out = totals.crossJoin(F.broadcast(whole)).withColumn("k", F.greatest(F.lit(1), F.floor(weight / F.col("all") * frame + 0.5)).cast("long"))
    out = out.withColumn("blocks", F.ceil(F.col("units") / block).cast("long"))
    return out.select("source", "k", "blocks", F.ceil(F.col("blocks") / F.col("k")).cast("long").alias("frames"))


#: Earliest deadline first over one frame: from live, an array of (source, k) by name, an array of (source, j, slot).
EDF = """
aggregate(sequence(0L, q - 1), named_struct('s', transform(live, x -> named_struct('source', x.source, 'k', x.k, 'j', 0L)), 'out', cast(array() as array<struct<source:string,j:bigint,slot:bigint>>)),
  (acc, t) -> element_at(transform(array(array_min(transform(filter(acc.s, x -> x.j < x.k and floor(x.j * q / x.k) <= t), x -> named_struct('due', cast(ceil((x.j + 1) * q / x.k) as bigint), 'source', x.source, 'j', x.j)))),
    p -> named_struct('s', transform(acc.s, x -> named_struct('source', x.source, 'k', x.k, 'j', if(x.source = p.source, x.j + 1, x.j))),
                      'out', concat(acc.out, array(named_struct('source', p.source, 'j', p.j, 'slot', t))))), 1),
  acc -> acc.out)
"""


def schedule(sources: DataFrame) -> DataFrame:
    """source, j, k, q, first and last frame of the phase, its first slot, slot in the frame: one row a block of one frame
    of each phase. A phase is a stretch of frames with the same live sources."""
    ends = sources.select(F.col("frames").alias("last")).distinct()
    phases = ends.crossJoin(sources).filter("frames >= last").groupBy("last").agg(F.array_sort(F.collect_list(F.struct("source", "k"))).alias("live"), F.sum("k").alias("q"))
    order = Window.partitionBy(F.lit(0)).orderBy("last")
    phases = phases.withColumn("first", F.coalesce(F.lag("last").over(order), F.lit(0)))
    phases = phases.withColumn("base", F.coalesce(F.sum((F.col("last") - F.col("first")) * F.col("q")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = phases.select("first", "last", "base", "q", "live", F.explode(F.expr(EDF)).alias("b"))
    k = F.element_at(F.map_from_entries("live"), F.col("b.source")).alias("k")
    return rows.select(F.col("b.source").alias("source"), F.col("b.j").alias("j"), k, "q", "first", "last", "base", F.col("b.slot").alias("in_frame"))


def _planned(docs: DataFrame, n: int, weights: dict[str, float] | None, block: int, frame: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The n rows of docs without their texts and where they begin, slots() and schedule() of them, all stored."""
    rows = common.stored(_begins(_ranged(_lengths(docs), n)))
    totals = common.stored(rows.groupBy("source").agg(F.sum("units").alias("units")))
    plan = common.stored(slots(totals, weights, block, frame))
    return rows, plan, common.stored(schedule(common.checked_broadcast(plan)))


def _slotted(rows: DataFrame, plan: DataFrame, table: DataFrame, block: int) -> DataFrame:
    """rows (source, begin, ...) with block_no, place, slot, release and deadline."""
    plan, table = common.checked_broadcast(plan), common.checked_broadcast(table)
    names = rows.columns
    rows = rows.withColumn("block_no", F.floor(F.col("begin") / block)).withColumn("place", F.col("begin") % block)
    rows = rows.join(plan.select("source", "k"), "source").withColumn("frame_no", F.floor(F.col("block_no") / F.col("k"))).withColumn("j", F.col("block_no") % F.col("k"))
    rows = rows.drop("k").join(table, ["source", "j"]).filter("frame_no >= first and frame_no < last")
    start = F.col("base") + (F.col("frame_no") - F.col("first")) * F.col("q")
    return rows.select(
        *names, "block_no", "place", (start + F.col("in_frame")).alias("slot"),
        (start + F.floor(F.col("j") * F.col("q") / F.col("k"))).alias("release"), (start + F.ceil((F.col("j") + 1) * F.col("q") / F.col("k"))).alias("deadline"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """docs (doc_id, source, text, ...) -> doc_id, source, units, block_no, place (characters from the block's start), slot,
    release, deadline (slots), one row a row of docs; (slot, place) is the mixed order."""
    rows, plan, table = _planned(docs, docs.count(), weights, block, frame)
    return _slotted(rows, plan, table, block).select("doc_id", "source", "units", "block_no", "place", "slot", "release", "deadline")


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """The rows of docs (doc_id, source, text, ...) in the mixed order: partitions are ranges of slots, rows follow slot and place.
    Rows that share doc_id, source and length share the first one's place."""
    n, order = docs.count(), ["key", "doc_id", "units"]
    rows, plan, table = _planned(docs, n, weights, block, frame)
    begins = rows.groupBy("source", "range", *order).agg(F.min("begin").alias("begin"))
    parts = _slotted(begins, plan, table, block).withColumn("part", F.floor(F.col("slot") / SLOTS))
    parts = parts.groupBy("source", "range", "part").agg(F.min(F.struct(*order)).alias("head"), F.min("begin").alias("since"))
    parts = parts.groupBy("source", "range").agg(F.array_sort(F.collect_list(F.struct("head", "part", "since"))).alias("parts"))
    parts = common.checked_broadcast(common.stored(parts))
    texts = _ranged(_lengths(docs, F.struct(*docs.columns).alias("row")), n).join(parts, ["source", "range"])
    texts = texts.withColumn("own", F.element_at(F.filter("parts", lambda p: p["head"] <= F.struct(*order)), -1))
    texts = texts.select("row", "source", "range", *order, "own.part", "own.since").repartitionByRange("part")
    # one sort serves both windows, and neither moves a row
    group = ["part", "source", "range"]
    before = F.sum("units").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    texts = texts.withColumn("begin", F.col("since") + F.coalesce(before, F.lit(0)))
    texts = texts.withColumn("begin", F.min("begin").over(Window.partitionBy(*group, *order)))
    texts = _slotted(texts.select("row", "source", "begin"), plan, table, block)
    if max(plan.count(), table.count()) > common.BROADCAST_ROWS:  # joins to larger tables move the rows
        texts = texts.repartitionByRange("slot", "place")
    return texts.sortWithinPartitions("slot", "place").select("row.*")
