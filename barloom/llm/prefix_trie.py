"""The trie of conversation prefixes, from sorted conversations and range minima of their common prefix lengths.

1. A turn becomes a 128-bit hash of (role, text) and its number of words; a conversation is the array of its turns' hashes.
2. Conversations are sorted by (array, conv_id) over ranges, so that copies of one conversation spread over tasks, and
   written as blocks of at most BLOCK_ROWS conversations and about BLOCK_TURNS turns, each with the neighbours' arrays.
3. In a block, lcp[i] is the common prefix length of conversation i and the one before it. A sparse table holds the
   minima of all power-of-two ranges of lcp. Each prefix (i, depth) finds the right end of its members by itself, by binary
   search over the table; a prefix whose parent began earlier finds the parent by a search to the left. There is no stack
   and no order between prefixes. Member counts, the smallest member (a second table), leaves and saved tokens are then
   differences of running sums over the interval.
4. An interval that goes on in another block is a part: parts carry a digest of their prefix and are added up by it. Only
   prefixes that the conversations on both sides of a block's edge share are parts, the root among them.

The ids of the conversations that end at a node are hashed where the node is whole. Of a part they travel as strings of
at most ID_CHUNK ids and are hashed in order as a stream; no task holds them together.

A conversation's hashes (20 bytes a turn) must fit into a task. Defined cases: a null role or text counts as empty; turns of equal number follow
the order of their hashes; a null turn number comes first; equal rows are turns of their own; rows without conv_id are left
out; a conversation rebuilt without turns is a member of the root only; an empty table has no node, not even a root; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm import common

BLOCK_ROWS = 4096
BLOCK_TURNS = 1 << 16
ID_CHUNK = 512
FAMILY = 20
HEAD = 4
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "whole boolean, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids string, part int, no int, seq int"
BLOCKS = "part int, no int, conv array<long>, lens array<int>, key array<long>, words array<int>, before array<long>, after array<long>, head array<long>, tail array<long>"


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the turns in order as (turn, a, b, words); a and b are two hashes of role and text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).filter("conv_id is not null")
    hashed = rows.select("conv_id", F.struct("turn", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
                                             F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).alias("turn"))
    return hashed.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def with_shared_heads(turns: DataFrame, family: int = FAMILY, most: int = HEAD) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % family; h = crc32(decimal c) % most."""
    heads = turns.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    rows = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    rows = rows.join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, conv_id, key, words) -> blocks; a block waits for the first key of the next."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    schema = pa.schema([(n, pa.int32() if n in ("part", "no") else pa.list_(pa.int32() if n in ("lens", "words") else pa.int64())) for n in names])
    waiting, last, no = None, None, 0

    def row(block: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([block], schema)

    for batch in batches:
        part, conv, keys, words = (batch.column(k) for k in range(4))
        lens = np.asarray(words.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        ends, first = np.cumsum(lens), 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            stop = min(first + most, max(first + 1, int(np.searchsorted(ends, done + BLOCK_TURNS, "right"))))
            key = keys.slice(first, stop - first).flatten().to_numpy(zero_copy_only=False)
            head, tail = key[: 2 * lens[first]], key[len(key) - 2 * lens[stop - 1] :]
            if waiting is not None:
                yield row(waiting | {"after": head, "tail": None})
            waiting = {"part": part[0].as_py(), "no": no, "conv": conv.slice(first, stop - first).to_numpy(), "lens": lens[first:stop].astype(np.int32), "key": key,
                       "words": words.slice(first, stop - first).flatten().to_numpy(zero_copy_only=False), "before": last, "after": None, "head": head if no == 0 else None, "tail": tail}
            last, no, first = tail, no + 1, stop
    if waiting is not None:
        yield row(waiting)


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Blocks in the order of (key, conv_id), each with the keys on both sides. Neighbours over a partition's edge come from a
    table of one row a partition."""
    flat = common.stored(rows.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")))
    ordered = flat.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = common.stored(ordered.select(F.spark_partition_id().alias("part"), "conv_id", "key", "words").mapInArrow(lambda batches: _packed(batches, most), BLOCKS))
    edges = blocks.groupBy("part").agg(F.first("head", True).alias("head"), F.first("tail", True).alias("tail"))
    in_order = Window.orderBy("part")  # a row a partition
    edges = edges.select("part", F.lag("tail").over(in_order).alias("earlier"), F.lead("head").over(in_order).alias("later"))
    blocks = blocks.drop("head", "tail").join(F.broadcast(edges), "part")
    return blocks.withColumn("before", F.coalesce("before", "earlier")).withColumn("after", F.coalesce("after", "later")).drop("earlier", "later")


def minima(values: np.ndarray) -> list[np.ndarray]:
    """table[k][i] is the minimum of values[i : i + 2**k]."""
    table = [values]
    while len(table[-1]) > 1 << (len(table) - 1):
        t, half = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(t[:-half], t[half:]))
    return table


def right_ends(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each (at, depth) the largest r with table's values at least depth in [at + 1, r)."""
    n, r = len(table[0]), at + 1
    for k in range(len(table) - 1, -1, -1):
        fits = r + (1 << k) <= n
        fits[fits] = table[k][r[fits]] >= depth[fits]
        r = r + (fits.astype(np.int64) << k)
    return r


def left_ends(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each (at, depth) the smallest l with table's values at least depth in (l, at]."""
    left = at
    for k in range(len(table) - 1, -1, -1):
        fits = left >= 1 << k
        fits[fits] = table[k][left[fits] - (1 << k) + 1] >= depth[fits]
        left = left - (fits.astype(np.int64) << k)
    return left


def range_minima(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima over [a, b), which is not empty."""
    k = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), table[0].dtype)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(table[level][a[at]], table[level][b[at] - (1 << int(level))])
    return out


def common_lengths(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Common prefix length of each array (rows off[i] to off[i + 1] of key) and the one before; 0 for the first."""
    size = np.diff(off)
    least = np.minimum(size[:-1], size[1:])
    begin = np.concatenate(([0], np.cumsum(least)))
    of = np.repeat(np.arange(len(least)), least)
    within = np.arange(begin[-1]) - begin[of]
    differ = np.flatnonzero((key[off[of] + within] != key[off[of + 1] + within]).any(axis=1))
    pair, first = np.unique(of[differ], return_index=True)
    out = np.concatenate(([0], least))
    out[pair + 1] = within[differ[first]]
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _digests(key: np.ndarray, depth: int) -> list[bytes]:
    """A digest of each of the first depth + 1 prefixes."""
    h, out = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        if d:
            h.update(key[d - 1].tobytes())
        out.append(h.copy().digest())
    return out


def block_nodes(conv: np.ndarray, lens: np.ndarray, key: np.ndarray, words: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> tuple[dict, list]:
    """Columns of the nodes of one block, and (node number, first id, id after the last) of those where conversations end."""
    n, off = len(conv), np.concatenate(([0], np.cumsum(lens)))
    lcp = common_lengths(key, off)
    lcp[0] = -1 if before is None else _common(before, key[: lens[0]])
    beyond = -1 if after is None else _common(key[off[-2] :], after)
    first = lcp + 1
    first[0] = 0
    count = lens - first + 1
    base = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(np.arange(n), count)
    depth = first[at] + np.arange(base[-1]) - base[at]
    table = minima(lcp)
    end = right_ends(table, at, depth)
    begun = depth > lcp[at]
    part = ~begun | ((end == n) & (depth <= beyond))
    parent = np.arange(len(at)) - 1
    opening = np.flatnonzero((count > 0) & (np.arange(n) > 0))
    left = left_ends(table, opening, lcp[opening])
    parent[base[opening]] = base[left] + lcp[opening] - first[left]
    total = np.concatenate(([0], np.cumsum(words.astype(np.int64))))
    upto = lambda i, d: total[off[i] + d] - total[off[i]]
    again = upto(np.arange(n), np.maximum(lcp, 0))
    running, above = np.concatenate(([0], np.cumsum(again))), upto(at, np.maximum(depth - 1, 0))
    leaf = np.concatenate(([0], np.cumsum(np.append(lcp[1:], beyond) < lens)))
    node = np.full(len(at), None, object)
    for path, deep, on in ((key[: lens[0]], int(lcp[0]), ~begun), (key[off[-2] :], beyond, (end == n) & (depth <= beyond))):
        if deep >= 0:
            node[on] = np.array([*_digests(path, deep), None], object)[depth[on]]
    smallest = range_minima(minima(conv), at, end)
    known = parent >= 0
    out = {"whole": ~part, "node": node, "parent": np.where(known, node[parent], None), "conv_id": smallest, "depth": depth, "parent_conv_id": np.where(known & ~part[parent], smallest[parent], -1),
           "has_parent": known & ~part[parent], "n_convs": end - at, "n_children": np.bincount(parent[begun & known], minlength=len(at)), "n_leaves": leaf[end] - leaf[at],
           "saved_tokens": running[end] - running[at + 1] - (end - at - 1) * above + np.where(begun, 0, again[at] - above)}
    equal = np.append(False, (lcp[1:] == lens[1:]) & (lens[1:] == lens[:-1]))
    stops = np.append(np.flatnonzero(~equal), n)
    last = np.flatnonzero(depth == lens[at])
    return out, list(zip(last.tolist(), at[last].tolist(), stops[np.searchsorted(stops, at[last], "right")].tolist(), strict=True))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in NODES.split(", ")]
    arrow = {"boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = {c.split()[0]: arrow[c.split()[1]] for c in NODES.split(", ")}
    for batch in batches:
        for r in range(batch.num_rows):
            get = {n: batch.column(k)[r] for k, n in enumerate(batch.schema.names)}
            pairs = lambda n: None if not get[n].is_valid else get[n].values.to_numpy(zero_copy_only=False).reshape(-1, 2)  # noqa: E731, B023
            conv = get["conv"].values.to_numpy(zero_copy_only=False)
            lens = get["lens"].values.to_numpy(zero_copy_only=False).astype(np.int64)
            cols, ends = block_nodes(conv, lens, pairs("key"), get["words"].values.to_numpy(zero_copy_only=False), pairs("before"), pairs("after"))
            n = len(cols["depth"])
            sha = np.full(n, NO_ENDS, object)
            chunks = []
            for i, a, b in ends:
                ids = conv[a:b].tolist()
                if cols["whole"][i]:
                    sha[i] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                else:
                    sha[i] = None
                    chunks += [{"node": cols["node"][i], "ids": ",".join(map(str, ids[k : k + ID_CHUNK])), "part": get["part"].as_py(), "no": get["no"].as_py(), "seq": k // ID_CHUNK} for k in range(0, len(ids), ID_CHUNK)]
            arrays = []
            for name in names:
                if name == "parent_conv_id":
                    arrays.append(pa.array(cols[name], pa.int64(), mask=~cols["has_parent"]))
                elif name == "ends_sha256":
                    arrays.append(pa.array(sha, pa.string()))
                elif name in cols:
                    arrays.append(pa.array(cols[name], types[name]))
                else:
                    arrays.append(pa.nulls(n, types[name]))
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            if chunks:
                yield pa.RecordBatch.from_pylist(chunks, pa.schema(list(types.items())))


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ids) sorted by node and order -> (node, ends_sha256), as a stream."""
    now, h = None, None
    for batch in batches:
        done = []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if h is not None:
                    done.append((now, h.hexdigest()))
                now, h = node, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["node", "ends_sha256"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def trie(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """turns (conv_id, turns as of turn_arrays) -> a row a distinct prefix."""
    found = common.stored(_blocks(turns, block_rows).mapInArrow(_nodes, NODES))
    chunks = found.filter("ids is not null").select("node", "ids", "part", "no", "seq")
    hashed = chunks.repartition("node").sortWithinPartitions("node", "part", "no", "seq").select("node", "ids").mapInArrow(_hashed_ids, "node binary, ends_sha256 string")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    parts = found.filter("not whole").groupBy("node").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *[F.sum(c).alias(c) for c in sums])
    parts = common.stored(parts.join(hashed, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    above = parts.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    whole = found.filter("whole")
    inner = common.look_up(whole.filter("parent is not null").drop("parent_conv_id"), "parent", above, "conv_id", parts.count() <= common.BROADCAST_ROWS)
    return whole.filter("parent is null").select(out).union(inner.select(out)).union(parts.join(above, "parent", "left").select(out))


def prefix_nodes(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> the nodes of the rebuilt conversations' trie."""
    return trie(with_shared_heads(turn_arrays(conversations)), block_rows)
