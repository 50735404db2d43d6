"""Measures of one large graph, kept in tables: a step is a join of edges with the nodes' numbers and a sum by node.

A graph is a table of directed entries (src, dst, w); undirected edges are there both ways. Nothing is dense and only
matrices of the basis size (at most ``BASIS`` rows) reach the driver. Nodes' numbers are broadcast to the edges while the nodes were
counted to be few; beyond that both sides are shuffled by node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import BROADCAST_ROWS, stored

#: Vectors that a solver moves at once, and vectors it keeps before it starts again from the best ones.
WIDTH, BASIS = 8, 96
RESIDUAL = 1e-10
#: (table of (node, x: numbers), their count, nodes) -> (node, y: numbers), the product of a symmetric matrix with the vectors.
Operator = Callable[[DataFrame, int, int], DataFrame]


def _held(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def held(table: DataFrame) -> DataFrame:
    """The stored table, with a broadcast hint if it was counted to be small."""
    table = stored(table)
    return _held(table, table.count())


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges reach. Labels spread along edges and jump to their own label's label,
    so that long chains take few rounds."""
    both = stored(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct())
    labels = stored(nodes_of(edges).withColumn("component", F.col("node")))
    n = labels.count()
    while True:
        near = both.join(_held(labels, n), F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near"))
        step = stored(labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.least("component", F.coalesce("near", "component")).alias("to"), F.col("component").alias("was")))
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("component"))
        after = stored(step.join(_held(jump, n), "to").select("node", "component", "was"))
        if not after.where("component < was").take(1):
            return labels
        labels = after.select("node", "component")


# ---- eigenvectors ----------------------------------------------------------------------------


def _rows(col: pd.Series, width: int) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) and width else np.zeros((len(col), width))


def _products(table: DataFrame, size: int, width: int, lower: np.ndarray | None = None) -> np.ndarray:
    """Inner products of the basis q and of the block w with w; with ``lower``, of w less q @ lower."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + width, width))
        for f in frames:
            q, w = _rows(f["q"], size), _rows(f["w"], width)
            w = w if lower is None else w - q @ lower
            total += np.concatenate((q, w), axis=1).T @ w
        yield pd.DataFrame({"at": np.arange(total.size), "part": total.ravel()})

    sums = table.select("q", "w").mapInPandas(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("s")).collect()
    out = np.zeros((size + width) * width)
    for r in sums:
        out[r["at"]] = r["s"]
    return out.reshape(size + width, width)


def _extended(table: DataFrame, size: int, width: int, lower: np.ndarray, turn: np.ndarray) -> DataFrame:
    """The basis with (w - q @ lower) @ turn as further vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            q, w = _rows(f["q"], size), _rows(f["w"], width)
            f = f.drop(columns="w")
            f["q"] = list(np.concatenate((q, (w - q @ lower) @ turn), axis=1))
            yield f

    return table.mapInPandas(run, "node string, component string, still double, q array<double>")


def _combined(table: DataFrame, size: int, mix: np.ndarray, name: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"node": f["node"], name: list(_rows(f["q"], size) @ mix)})

    return table.select("node", "q").mapInPandas(run, f"node string, {name} array<double>")


def _cleared(table: DataFrame, width: int) -> DataFrame:
    """The block less its share of each component's still vector, which the entries keep as it is."""
    if not width:
        return table
    sums = table.groupBy("component").agg(F.array(*[F.sum(F.col("still") * F.col("w")[i]) for i in range(width)]).alias("share"))
    return table.join(sums, "component").withColumn("w", F.zip_with("w", "share", lambda x, y: x - F.col("still") * y)).drop("share").select("node", "component", "still", "q", "w")


def weighted_sums(rows: DataFrame, by: str, weight: str, width: int) -> DataFrame:
    """y: for each key the sum of the vectors x by weight."""
    return rows.groupBy(by).agg(F.array(*[F.sum(F.col(weight) * F.col("x")[i]) for i in range(width)]).alias("y"))


def matrix(entries: DataFrame) -> Operator:
    """The operator of a symmetric matrix given as entries (src, dst, w)."""
    entries = stored(entries.select(F.col("src").cast("string"), F.col("dst").cast("string"), "w"))
    return lambda x, width, n: weighted_sums(entries.join(_held(x.withColumnRenamed("node", "src"), n), "src"), "dst", "w", width).withColumnRenamed("dst", "node")


def gram(cells: DataFrame) -> Operator:
    """The operator X X' of a table of cells (node, at, value), without its entries: to the columns and back."""
    cells = stored(cells.select(F.col("node").cast("string").alias("node"), "at", F.col("value").cast("double").alias("value")))

    def apply(x: DataFrame, width: int, n: int) -> DataFrame:
        columns = weighted_sums(cells.join(_held(x, n), "node"), "at", "value", width).withColumnRenamed("y", "x")
        return weighted_sums(cells.join(columns, "at"), "node", "value", width)

    return apply


def _applied(operator: Operator, table: DataFrame, size: int, width: int, n: int) -> DataFrame:
    """w: the operator's product with the last vectors of the basis."""
    last = table.select("node", F.slice("q", size - width + 1, width).alias("x"))
    zero = F.array(*[F.lit(0.0)] * width)
    return table.join(operator(last, width, n), "node", "left").select("node", "component", "still", "q", F.coalesce("y", zero).alias("w"))


def leading_vectors(operator: Operator, still: DataFrame, wanted: int = 1, *, width: int = WIDTH, basis: int = BASIS, tol: float = RESIDUAL, restarts: int = 20) -> tuple[np.ndarray, DataFrame]:
    """Largest eigenvalues of a symmetric operator and their unit vectors, (node, v).

    ``still`` has every node with its component and the component's known unit vector, which is left out; 0 leaves out nothing. Block Krylov
    steps with full orthogonalisation, done twice; a step's new vectors are found from inner products only. It ends when the
    wanted residuals are below ``tol`` or the space is exhausted, and starts again from the best vectors when the basis is full.
    """
    still = still.select(F.col("node").cast("string").alias("node"), F.col("component").cast("string").alias("component"), F.col("still").cast("double").alias("still"))
    n = still.count()
    width, wanted = min(max(width, wanted + 1), max(n, 1)), min(wanted, n)
    if not n:
        return np.zeros(0), still.select("node", F.array().cast("array<double>").alias("v"))
    start = F.array(*[F.xxhash64("node", F.lit(i)) / float(1 << 63) for i in range(width)])
    table, b = stored(_cleared(still.withColumn("q", F.array().cast("array<double>")).withColumn("w", start), width)), width
    for _ in range(restarts):
        size, columns, sizes = 0, [], []
        while True:
            first = _products(table, size, b)
            below = first[:size]
            again = _products(table, size, b, below)
            below, rest = below + again[:size], again[size:] - again[:size].T @ again[:size]
            values, turn = np.linalg.eigh(rest)
            new = values > 1e-16 * max(1.0, np.trace(first[size:]))
            scale = np.sqrt(values[new])
            if size:
                columns.append((below, scale[:, None] * turn[:, new].T))
                t = np.zeros((size, size))
                for k, (h, s) in enumerate(columns):
                    at = slice(sum(sizes[:k]), sum(sizes[: k + 1]))
                    t[: len(h), at] = h
                    if k + 1 < len(columns):
                        t[len(h) : len(h) + len(s), at] = s
                theta, ritz = np.linalg.eigh((t + t.T) / 2)
                theta, ritz = theta[::-1], ritz[:, ::-1]
                left = np.linalg.norm(columns[-1][1] @ ritz[size - sizes[-1] :, :wanted], axis=0) if new.any() else np.zeros(wanted)
                if not new.any() or (size >= wanted and left.max() < tol * max(1.0, abs(theta[0]))) or size >= n:
                    k = min(wanted, size)
                    return theta[:k], _combined(table, size, ritz[:, :k], "v")
                if size + new.sum() > basis:
                    break
            elif not new.any():
                return np.zeros(0), _combined(table, 0, np.zeros((0, 0)), "v")
            grown = stored(_extended(table, size, b, below, turn[:, new] / scale))
            b = int(new.sum())
            size, sizes = size + b, [*sizes, b]
            table = stored(_cleared(_applied(operator, grown, size, b, n), b))
        # the best vectors of this basis are the next start
        b = min(width, size)
        best = _combined(table, size, ritz[:, :b], "w")
        empty = table.select("node", "component", "still", F.array().cast("array<double>").alias("q"))
        table = stored(_cleared(empty.join(best, "node").select("node", "component", "still", "q", "w"), b))
    raise RuntimeError(f"residual {left.max():.2e} after {restarts} starts")


def signed(vectors: DataFrame, width: int) -> DataFrame:
    """(node, v): each vector turned so that the first name with a loading has a positive one."""
    if not width:
        return vectors
    v = F.col("v")
    leads = [F.min_by(F.when(F.abs(v[i]) > 1e-9, v[i]), F.when(F.abs(v[i]) > 1e-9, F.col("node"))) for i in range(width)]
    lead = vectors.agg(F.array(*leads).alias("lead"))
    return vectors.join(F.broadcast(lead)).select("node", F.zip_with("v", "lead", lambda x, y: F.when(y < 0, -x).otherwise(x)).alias("v"))


def laplacian_vectors(edges: DataFrame, wanted: int = 1) -> tuple[np.ndarray, DataFrame]:
    """Smallest nonzero eigenvalues of the normalised Laplacian, and (node, v). Its zero eigenvalues belong to the components, one
    known vector each, and are left out beforehand."""
    edges = stored(edges.select("src", "dst", "w").where("w > 0 and src != dst"))
    degree = stored(edges.groupBy("src").agg(F.sum("w").alias("degree")))
    n = degree.count()
    d = lambda end: _held(degree.select(F.col("src").alias(end), F.col("degree").alias(f"d_{end}")), n)
    entries = edges.join(d("src"), "src").join(d("dst"), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("w"))
    own = components(edges).join(degree.withColumnRenamed("src", "node"), "node")
    total = own.groupBy("component").agg(F.sum("degree").alias("all"))
    still = stored(own.join(total, "component").select("node", "component", F.sqrt(F.col("degree") / F.col("all")).alias("still")))
    values, vectors = leading_vectors(matrix(entries), still, wanted)
    return 1.0 - values, vectors


def fiedler_pair(edges: DataFrame) -> DataFrame:
    """(symbol, fiedler_value, fiedler): the first eigenvector of the normalised Laplacian above zero; no row if all are zero."""
    values, vectors = laplacian_vectors(edges)
    if not len(values):
        return vectors.limit(0).select(F.col("node").alias("symbol"), F.lit(0.0).alias("fiedler_value"), F.lit(0.0).alias("fiedler"))
    return signed(stored(vectors), 1).select(F.col("node").alias("symbol"), F.lit(float(values[0])).alias("fiedler_value"), F.col("v")[0].alias("fiedler"))


def pagerank(edges: DataFrame, alpha: float = 0.85, tol: float = 1e-11, unrolled: int = 10, most: int = 600) -> DataFrame:
    """(symbol, score). Solves y = alpha * P'y + 1/n and scales y to 1, which spreads the mass of nodes without outgoing weight
    evenly without adding it up in each step. Some steps run in one job; then the change is measured."""
    edges = stored(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "w"))
    nodes = stored(nodes_of(edges))
    n = nodes.count()
    if not n:
        return nodes.select(F.col("node").alias("symbol"), F.lit(0.0).alias("score"))
    out = edges.where("w > 0").groupBy("src").agg(F.sum("w").alias("out"))
    step = stored(edges.where("w > 0").join(_held(out, n), "src").select("src", "dst", (F.col("w") / F.col("out") * alpha).alias("p")))
    # the edges stay the same in all steps: while they are few, they are what is broadcast, once a job
    step = _held(step, step.count())
    base = nodes.withColumn("y", F.lit(1.0 / n))
    y, done = base, 0
    while True:
        x = y
        for _ in range(unrolled):
            last = x
            moved = x.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("p") * F.col("y")).alias("y"))
            x = moved.union(base).groupBy("node").agg(F.sum("y").alias("y"))
        both = stored(x.join(last.withColumnRenamed("y", "was"), "node"))
        y, done = both.select("node", "y"), done + unrolled
        change, total = both.agg(F.sum(F.abs(F.col("y") - F.col("was"))), F.sum("y")).first()
        if change <= tol * total or done >= most:
            return y.select(F.col("node").alias("symbol"), (F.col("y") / total).alias("score"))


def eigenvector(edges: DataFrame) -> DataFrame:
    """(symbol, score): the leading eigenvector; of a graph in several parts it is not unique, then PageRank."""
    edges = stored(edges.select("src", "dst", "w").where("w > 0"))
    parts = stored(components(edges))
    if parts.select("component").distinct().limit(2).count() != 1:
        return pagerank(edges)
    _, vectors = leading_vectors(matrix(edges), parts.withColumn("still", F.lit(0.0)))
    return vectors.select(F.col("node").alias("symbol"), F.abs(F.col("v")[0]).alias("score"))


# ---- shortest paths --------------------------------------------------------------------------

#: Numbers that a task holds for a block of sources: sources times edges.
PATH_CELLS = 4_000_000


def path_dependencies(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, sources: np.ndarray) -> np.ndarray:
    """For each node the sum over the sources of the shares of shortest paths that pass through it. All sources
    at once: distances by relaxing the edges until nothing changes, path counts hop by hop along tight edges, and dependencies
    back along them."""
    order = np.argsort(dst, kind="stable")
    src, dst, w = src[order], dst[order], w[order]
    heads, first = np.unique(dst, return_index=True)
    s, rows = len(sources), np.arange(len(sources))
    dist = np.full((s, n), np.inf)
    dist[rows, sources] = 0.0
    while len(heads):
        reach = np.minimum.reduceat(dist[:, src] + w, first, axis=1)
        if not (reach < dist[:, heads] * (1 - 1e-13)).any():
            break
        dist[:, heads] = np.minimum(dist[:, heads], reach)
    at = np.where(np.isfinite(dist), dist, -1.0)
    tight = np.isclose(at[:, src] + w, at[:, dst], rtol=1e-12, atol=1e-15) & (at[:, src] >= 0)
    count, paths = np.zeros((s, n)), np.zeros((s, n))
    count[rows, sources] = 1.0
    while count.any():
        paths += count
        moved = np.zeros((s, n))
        if len(heads):
            moved[:, heads] = np.add.reduceat(np.where(tight, count[:, src], 0.0), first, axis=1)
        count = moved
    share = np.divide(paths[:, src], paths[:, dst], out=np.zeros(tight.shape), where=tight & (paths[:, dst] > 0))
    back = np.argsort(src, kind="stable")
    tails, begin = np.unique(src[back], return_index=True)
    total, wave = np.zeros((s, n)), np.ones((s, n))
    while len(tails):
        moved = np.zeros((s, n))
        moved[:, tails] = np.add.reduceat((share * wave[:, dst])[:, back], begin, axis=1)
        if not moved.any():
            break
        total += moved
        wave = moved
    total[rows, sources] = 0.0
    return total.sum(axis=0)


def betweenness(edges: DataFrame, *, by: str = "t_no", cells: int = PATH_CELLS) -> DataFrame:
    """(by, symbol, score): shortest-path betweenness with the weight as distance. A task is a block of a graph's sources; it
    gets the graph's edges and gives a sum for each node. Exact, and no node is left out."""
    e = stored(edges.select(F.col(by).cast("long").alias("g"), "src", "dst", "w").where("w > 0 and src != dst"))
    nodes = e.select("g", F.col("src").alias("node")).union(e.select("g", F.col("dst").alias("node"))).distinct()
    size = e.groupBy("g").agg(F.count("*").alias("m")).join(nodes.groupBy("g").agg(F.count("*").alias("n")), "g")
    blocks = size.select("g", "n", F.least("n", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("m") / cells))).cast("int").alias("blocks"))
    tasks = blocks.select("g", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(np.concatenate((pdf["src"].to_numpy(), pdf["dst"].to_numpy())), return_inverse=True)
        src, dst = ends[: len(pdf)], ends[len(pdf) :]
        mine = np.arange(int(pdf["block"].iloc[0]), len(names), int(pdf["blocks"].iloc[0]))
        score = path_dependencies(src, dst, pdf["w"].to_numpy(float), len(names), mine)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "symbol": names, "part": score})

    parts = e.join(tasks, "g").groupBy("g", "block").applyInPandas(run, "g long, symbol string, part double")
    out = parts.groupBy("g", "symbol").agg(F.sum("part").alias("part")).join(blocks.select("g", "n"), "g")
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return out.select(F.col("g").alias(by), "symbol", F.when(F.col("n") > 2, F.col("part") / pairs).otherwise(F.col("part")).alias("score"))
