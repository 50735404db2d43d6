"""Pairwise sums, correlation graphs, clustering and allocation.

The work on pairs of assets is done in tiles: a task sees one stretch of time and two
groups of at most ``TILE`` assets as two dense matrices, and emits sums (or the best
neighbours) only. Rows are never joined pair by pair, so the shuffle grows with the
number of pairs times the number of stretches, not times the number of timestamps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators import graphs
from barloom.operators.indicators import log_return
from barloom.operators.joins import calendar
from barloom.operators.layout import BLOCK, over_blocks
from barloom.operators.order_stats import average_ranks, medians
from barloom.session import attach, durable

TILE, STRETCH = 128, 512


def log_returns(bars: DataFrame, *, block: int = BLOCK) -> DataFrame:
    r = over_blocks(bars, lambda f: {"ret": log_return(f, "close")}, back=1, block=block)
    return r.where(F.col("ret").isNotNull()).select("symbol", "ts", "ret")


def symbol_index(rows: DataFrame) -> DataFrame:
    """symbol -> s_no, dense, in alphabetical order. One row per asset of the universe."""
    names = rows.select("symbol").distinct()
    return names.withColumn("s_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("symbol")) - 1)


def _indexed(rows: DataFrame, step_seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    symbols, cal = durable(symbol_index(rows)), durable(calendar(rows, step_seconds=step_seconds))
    return attach(rows, symbols).join(cal, "ts"), symbols, cal


def _tile_pairs(rows: DataFrame, n_symbols: int, tile: int, back: int = 0, stretch: int = STRETCH) -> DataFrame:
    """Copy each row to the tile pairs and time stretches that need it."""
    n_tiles = -(-n_symbols // tile)
    mine = F.floor(F.col("s_no") / tile).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.lit(n_tiles - 1)),
        lambda j: F.struct(F.least(mine, j).alias("ti"), F.greatest(mine, j).alias("tj")),
    )
    blk = F.floor(F.col("t_no") / F.lit(stretch))
    spots = F.array(blk) if not back else F.when(
        F.col("t_no") - blk * stretch >= stretch - back, F.array(blk, blk + 1)
    ).otherwise(F.array(blk))
    return rows.select("*", F.inline(others)).withColumn("tb", F.explode(spots))


def _matrix(pdf: pd.DataFrame, col: str, no: int, tile: int, n_symbols: int, t0: int, rows: int) -> np.ndarray:
    width = min(tile, n_symbols - no * tile)
    m = np.full((rows, width), np.nan)
    s = pdf["s_no"].to_numpy() - no * tile
    inside = (s >= 0) & (s < width)
    m[pdf["t_no"].to_numpy()[inside] - t0, s[inside]] = pdf[col].to_numpy(dtype=float)[inside]
    return m


_SUMS = "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double"


def pair_sums(
    rows: DataFrame, left: str, right: str, n_symbols: int, *, ordered: bool = False, tile: int = TILE
) -> DataFrame:
    """Sums over the timestamps where both assets have a value: n, x, y, x², y², xy.

    ``rows`` holds s_no, t_no and the columns; NULL is missing. ``ordered`` also gives
    (b, a) and (a, a), which matters when left and right differ.
    """

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        t0 = int(pdf["t_no"].min())
        size = int(pdf["t_no"].max()) - t0 + 1
        parts = []
        for p, q in ((ti, tj), (tj, ti)) if ordered and ti != tj else ((ti, tj),):
            x, y = _matrix(pdf, left, p, tile, n_symbols, t0, size), _matrix(pdf, right, q, tile, n_symbols, t0, size)
            mx, my = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            n = mx.T @ my
            cells = {"n": n, "sx": x.T @ my, "sy": mx.T @ y, "sxx": (x * x).T @ my, "syy": mx.T @ (y * y), "sxy": x.T @ y}
            a, b = np.meshgrid(np.arange(n.shape[0]) + p * tile, np.arange(n.shape[1]) + q * tile, indexing="ij")
            keep = (n > 0) & ((a < b) | ordered)
            parts.append(pd.DataFrame({"a": a[keep], "b": b[keep], **{k: v[keep] for k, v in cells.items()}}))
        return pd.concat(parts)

    tiles = _tile_pairs(rows.select("s_no", "t_no", *dict.fromkeys((left, right))), n_symbols, tile)
    partial = tiles.groupBy("ti", "tj", "tb").applyInPandas(sums, _SUMS)
    return partial.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def _pearson():
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    noise = F.lit(1e-13) * n
    real = (n >= 2) & (vx > noise * F.col("sxx")) & (vy > noise * F.col("syy"))
    return F.when(real, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(real, vx * vy)))


#: Numbers that a task holds of one side of a tile when it ranks within pairs: timestamps times assets.
RANK_CELLS = 8_000_000


def _average_ranks(x: np.ndarray) -> np.ndarray:
    _, at, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2.0)[at]


def rank_correlations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common rows of every column of x with every column of y, and the correlation of their ranks among those rows. Ranks are
    taken once for each column and set of rows, so columns that miss the same rows cost no more than complete ones."""
    px, py = np.isfinite(x), np.isfinite(y)
    n, corr = px.T.astype(float) @ py.astype(float), np.full((x.shape[1], y.shape[1]), np.nan)
    kinds_x, of_x = np.unique(px, axis=1, return_inverse=True)
    kinds_y, of_y = np.unique(py, axis=1, return_inverse=True)
    for a in range(kinds_x.shape[1]):
        for b in range(kinds_y.shape[1]):
            rows = kinds_x[:, a] & kinds_y[:, b]
            if rows.sum() < 2:
                continue
            i, j = np.flatnonzero(of_x == a), np.flatnonzero(of_y == b)
            r = [np.stack([_average_ranks(m[rows, c]) for c in at], axis=1) for m, at in ((x, i), (y, j))]
            r = [m - m.mean(axis=0) for m in r]
            size = np.sqrt(np.outer((r[0] ** 2).sum(axis=0), (r[1] ** 2).sum(axis=0)))
            corr[np.ix_(i, j)] = np.divide(r[0].T @ r[1], size, out=np.zeros(size.shape), where=size > 0)
    return n, corr


def _ranked_within_pairs(rows: DataFrame, n_symbols: int, n_times: int, tile: int) -> DataFrame:
    """(a, b, n, corr) with ranks among the timestamps that both assets have. A task holds two tiles of assets over all time;
    tiles get narrower the longer the time is."""
    tile = max(1, min(tile, RANK_CELLS // max(1, n_times)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        x, y = (_matrix(pdf, "_x", k, tile, n_symbols, 0, n_times) for k in (ti, tj))
        n, corr = rank_correlations(x, y)
        a, b = np.meshgrid(np.arange(n.shape[0]) + ti * tile, np.arange(n.shape[1]) + tj * tile, indexing="ij")
        keep = (n > 0) & (a < b)
        return pd.DataFrame({"a": a[keep], "b": b[keep], "n": n[keep], "corr": corr[keep]})

    tiles = _tile_pairs(rows.select("s_no", "t_no", "_x"), n_symbols, tile, stretch=max(1, n_times))
    return tiles.groupBy("ti", "tj").applyInPandas(run, "a int, b int, n double, corr double")


def correlation_pairs(
    returns: DataFrame, *, value: str = "ret", method: str = "pearson", use_abs: bool = False, step_seconds: int = 86_400, tile: int = TILE
) -> DataFrame:
    """(src, dst, n, corr, sim) for unordered pairs over their common timestamps.

    Spearman ranks are those among the pair's common timestamps. Where all assets have the same timestamps these are the ranks of
    each asset, taken once and over blocks of time; else every pair of tiles ranks anew.
    """
    r = durable(returns.where(F.col(value).isNotNull()).select("symbol", "ts", F.col(value).alias("_x")))
    if method.strip().lower().startswith("spear"):
        size = r.agg(F.count("*"), F.countDistinct("symbol"), F.countDistinct("ts")).first()
        if size[0] < size[1] * size[2]:
            rows, symbols, _ = _indexed(r, step_seconds)
            pairs = _ranked_within_pairs(rows, size[1], size[2], tile).withColumn("corr", F.coalesce(F.nanvl("corr", F.lit(None)), F.lit(0.0)))
            return _named_pairs(pairs, symbols, use_abs)
        r = durable(average_ranks(r, ["symbol"], "_x", "_r").select("symbol", "ts", F.col("_r").alias("_x")))
    mean = r.groupBy("symbol").agg(F.avg("_x").alias("_m"))
    # a shift per asset leaves the correlation alone and keeps the sums well conditioned
    r = attach(r, mean).withColumn("_x", F.col("_x") - F.col("_m")).drop("_m")
    rows, symbols, _ = _indexed(r, step_seconds)
    n_symbols = symbols.count()
    pairs = pair_sums(rows, "_x", "_x", n_symbols, tile=tile).withColumn("corr", F.coalesce(_pearson(), F.lit(0.0)))
    return _named_pairs(pairs, symbols, use_abs)


def _named_pairs(pairs: DataFrame, symbols: DataFrame, use_abs: bool) -> DataFrame:
    c = F.abs("corr") if use_abs else F.col("corr")
    names = symbols.select(F.col("s_no").alias("a"), F.col("symbol").alias("src"))
    names2 = symbols.select(F.col("s_no").alias("b"), F.col("symbol").alias("dst"))
    return pairs.join(names, "a").join(names2, "b").select(
        "src", "dst", F.col("n").cast("long").alias("n"), "corr", ((c + 1.0) / 2.0).alias("sim")
    )


def both_ways(pairs: DataFrame, weight: str = "sim") -> DataFrame:
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    return pairs.select(*rest, F.inline(ends))


def knn_edges(pairs: DataFrame, k: int, *, by: tuple[str, ...] = (), weight: str = "sim") -> DataFrame:
    """The k most similar neighbours of each node (ties: the later name), made symmetric."""
    directed = both_ways(pairs)
    w = Window.partitionBy(*by, "src").orderBy(F.desc(weight), F.desc("dst"))
    top = directed.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    sym = both_ways(top.select(*by, "src", "dst", weight))
    return sym.groupBy(*by, "src", "dst").agg(F.max(weight).alias("w"))


def laplacian(edges: DataFrame, *, by: tuple[str, ...] = (), normalised: bool = True) -> DataFrame:
    """Sparse entries (src, dst, value); a node without weight scales to zero."""
    deg = edges.groupBy(*by, "src").agg(F.sum("w").alias("deg"))
    inv = lambda d: F.coalesce(1.0 / F.sqrt(F.when(d > 0, d)), F.lit(0.0))
    off = edges.join(deg, [*by, "src"]).join(
        deg.select(*by, F.col("src").alias("dst"), F.col("deg").alias("deg_d")), [*by, "dst"]
    )
    scale = inv(F.col("deg")) * inv(F.col("deg_d")) if normalised else F.lit(1.0)
    off = off.select(*by, "src", "dst", (-F.col("w") * scale).alias("value"))
    own = deg.select(*by, "src", F.col("src").alias("dst"), (F.lit(1.0) if normalised else F.col("deg")).alias("value"))
    return off.unionByName(own)


# ---- measures of a graph ---------------------------------------------------------------------
# One graph is measured by table operations (graphs.py), whatever its size. Of many graphs, one a window, the small
# ones are tasks of their own.

KERNEL_NODES = 2_000


def fiedler_vectors(edges: DataFrame) -> DataFrame:
    """First eigenvector of the normalised Laplacian with an eigenvalue above zero. The sign is fixed by the first name with a
    loading."""
    return graphs.fiedler_pair(edges)


def bipartition(vectors: DataFrame, *, method: str = "median") -> DataFrame:
    """Cluster 1 at or above the median (or zero), else 0."""
    if method == "sign":
        return vectors.withColumn("cluster", (F.col("fiedler") >= 0).cast("int"))
    med = medians(vectors.withColumn("_g", F.lit(0)), ["_g"], "fiedler", "_m").select("_m")
    return vectors.join(F.broadcast(med)).withColumn("cluster", (F.col("fiedler") >= F.col("_m")).cast("int")).drop("_m")


def spectral_clusters(returns: DataFrame, *, k: int = 8, use_abs: bool = False, method: str = "pearson", step_seconds: int = 86_400) -> DataFrame:
    """Correlation -> nearest-neighbour graph -> Fiedler vector -> two clusters."""
    edges = knn_edges(correlation_pairs(returns, use_abs=use_abs, method=method, step_seconds=step_seconds), k)
    return bipartition(fiedler_vectors(edges))


def _adjacency(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    names = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
    m = np.zeros((names.size, names.size))
    m[np.searchsorted(names, pdf["src"]), np.searchsorted(names, pdf["dst"])] = pdf["w"]
    return names, m


def _pagerank(names: np.ndarray, m: np.ndarray, alpha: float = 0.85, steps: int = 100) -> np.ndarray:
    n = names.size
    out = m.sum(axis=1)
    step = np.divide(m, out[:, None], out=np.zeros_like(m), where=out[:, None] > 0)
    x = np.full(n, 1.0 / n)
    for _ in range(steps):
        new = alpha * (x @ step + x[out == 0].sum() / n) + (1.0 - alpha) / n
        if np.abs(new - x).sum() < n * 1e-12:
            return new
        x = new
    return x


def _eigenvector(names: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Leading eigenvector; on a disconnected graph it is not unique, then PageRank."""
    seen, frontier = np.zeros(names.size, bool), np.zeros(names.size, bool)
    frontier[0] = True
    while frontier.any():
        seen |= frontier
        frontier = (m[frontier].sum(axis=0) > 0) & ~seen
    if not seen.all():
        return _pagerank(names, m)
    return np.abs(np.linalg.eigh(m)[1][:, -1])


_CENTRALITY = {"pagerank": (_pagerank, graphs.pagerank), "eigenvector": (_eigenvector, graphs.eigenvector)}


def centrality(edges: DataFrame, kind: str = "pagerank", *, by: str | None = "t_no", kernel_nodes: int = KERNEL_NODES) -> DataFrame:
    """Centrality of every node, of one graph or (``by``) of every window's graph. A window with at most ``kernel_nodes`` nodes is a
    task; a larger one goes through tables like a single graph, one after the other."""
    if kind == "betweenness":
        return graphs.betweenness(edges, by=by) if by else graphs.betweenness(edges.withColumn("_g", F.lit(0)), by="_g").drop("_g")
    kernel, whole = _CENTRALITY[kind]
    if by is None:
        return whole(edges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = _adjacency(pdf)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "symbol": names, "score": kernel(names, m)})

    e = durable(edges.select(F.col(by).cast("long").alias("g"), "src", "dst", "w"))
    sizes = e.groupBy("g").agg(F.countDistinct("src").alias("n"))
    large = [r["g"] for r in sizes.where(F.col("n") > kernel_nodes).collect()]
    few = e.where(~F.col("g").isin(large)) if large else e
    out = few.groupBy("g").applyInPandas(run, "g long, symbol string, score double")
    for g in large:
        out = out.unionByName(whole(e.where(F.col("g") == g)).withColumn("g", F.lit(g)))
    return out.withColumnRenamed("g", by)


def rolling_networks(
    returns: DataFrame, *, window: int = 60, k: int = 8, use_abs: bool = True, step_seconds: int = 86_400, stretch: int = STRETCH,
    tile: int = TILE,
) -> DataFrame:
    """Nearest-neighbour correlation network at every timestamp with a full window.

    A task computes the rolling correlations of one tile pair over one stretch of time and
    keeps the k best neighbours of each node and timestamp, so that the T x A² similarities
    exist only inside tasks. The best of the kept ones over all tiles are the network.
    """
    r = durable(returns.where(F.col("ret").isNotNull()).select("symbol", "ts", "ret"))
    mean = r.groupBy("symbol").agg(F.avg("ret").alias("_m"))
    r = attach(r, mean).select("symbol", "ts", (F.col("ret") - F.col("_m")).alias("x"))
    rows, symbols, cal = _indexed(r, step_seconds)
    n_symbols = symbols.count()
    size = max(stretch, window)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj, tb = (int(pdf[c].iloc[0]) for c in ("ti", "tj", "tb"))
        t0, last = tb * size - (window - 1), int(pdf["t_no"].max())
        x = _matrix(pdf, "x", ti, tile, n_symbols, t0, last - t0 + 1)
        y = x if ti == tj else _matrix(pdf, "x", tj, tile, n_symbols, t0, last - t0 + 1)
        mx, my = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        out = []
        for t in range(max(window - 1, 0), x.shape[0]):
            if t0 + t < window - 1:
                continue
            s = slice(t - window + 1, t + 1)
            a, b, ma, mb = x[s], y[s], mx[s], my[s]
            n = ma.T @ mb
            sx, sy = a.T @ mb, ma.T @ b
            vx, vy = n * ((a * a).T @ mb) - sx * sx, n * (ma.T @ (b * b)) - sy * sy
            floor_x, floor_y = 1e-13 * n * ((a * a).T @ mb), 1e-13 * n * (ma.T @ (b * b))
            ok = (n >= 2) & (vx > floor_x) & (vy > floor_y)
            corr = np.where(ok, (n * (a.T @ b) - sx * sy) / np.sqrt(np.where(ok, vx * vy, 1.0)), 0.0)
            sim = (np.abs(corr) + 1.0) / 2.0 if use_abs else (corr + 1.0) / 2.0
            ids_a, ids_b = np.arange(sim.shape[0]) + ti * tile, np.arange(sim.shape[1]) + tj * tile
            for src, dst, m in ((ids_a, ids_b, sim),) if ti == tj else ((ids_a, ids_b, sim), (ids_b, ids_a, sim.T)):
                m = np.where(src[:, None] == dst[None, :], -1.0, m)
                # stable sort of the reversed columns: equal similarities take the later node
                top = dst.size - 1 - np.argsort(-m[:, ::-1], axis=1, kind="stable")[:, :k]
                w = np.take_along_axis(m, top, axis=1)
                keep = w >= 0
                out.append(pd.DataFrame({
                    "t_no": t0 + t, "a": np.repeat(src, top.shape[1])[keep.ravel()], "b": dst[top][keep], "sim": w[keep],
                }))
        return pd.concat(out) if out else pd.DataFrame({"t_no": [], "a": [], "b": [], "sim": []})

    tiles = _tile_pairs(rows.select("s_no", "t_no", "x"), n_symbols, tile, back=window - 1, stretch=size)
    near = tiles.groupBy("ti", "tj", "tb").applyInPandas(best, "t_no long, a int, b int, sim double")
    names = symbols.select(F.col("s_no").alias("a"), F.col("symbol").alias("src"))
    names2 = symbols.select(F.col("s_no").alias("b"), F.col("symbol").alias("dst"))
    w = Window.partitionBy("t_no", "a").orderBy(F.desc("sim"), F.desc("b"))
    top = near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    top = top.join(names, "a").join(names2, "b").select("t_no", "src", "dst", "sim")
    edges = both_ways(top).groupBy("t_no", "src", "dst").agg(F.max("sim").alias("w"))
    return edges.join(cal, "t_no")


# ---- allocation ------------------------------------------------------------------------------


def trailing_volatility(rows: DataFrame, by: str, *, value: str = "ret", lookback: int = 60) -> DataFrame:
    """Sample deviation per key over the last ``lookback`` timestamps of the panel."""
    n = 60 if lookback <= 2 else lookback
    recent = rows.select("ts").distinct().orderBy(F.desc("ts")).limit(n)
    return rows.join(F.broadcast(recent), "ts", "left_semi").groupBy(by).agg(F.stddev_samp(value).alias("vol"))


def cluster_returns(returns: DataFrame, clusters: DataFrame) -> DataFrame:
    return returns.join(clusters.select("symbol", "cluster"), "symbol", "left").groupBy(
        "ts", F.coalesce("cluster", F.lit(0)).alias("cluster")
    ).agg(F.avg("ret").alias("ret"))


def allocate(
    returns: DataFrame, clusters: DataFrame, *, lookback: int = 60, cluster_budget: str = "inverse_vol",
    within_cluster: str = "inverse_vol", min_weight: float = 0.0, max_weight: float | None = None, eps: float = 1e-12,
) -> DataFrame:
    """Budget over clusters, then within each cluster; clipped and normalised once more.
    Adds the volatility and the diagonal risk contribution."""
    equal = {"equal", "ew"}
    clusters = durable(clusters.select("symbol", "cluster"))
    assets = returns.select("symbol").distinct().join(clusters.select("symbol", "cluster"), "symbol", "left").fillna(0, ["cluster"])
    vol = trailing_volatility(returns, "symbol", lookback=lookback)
    cvol = trailing_volatility(cluster_returns(returns, clusters), "cluster", lookback=lookback)
    inverse = lambda v: 1.0 / (F.when(F.col(v) != 0, F.col(v)) + eps)
    c = cvol.withColumn("_cw", F.lit(1.0) if cluster_budget in equal else inverse("vol")).select("cluster", F.coalesce("_cw", F.lit(0.0)).alias("_cw"))
    c = durable(c)
    c = c.join(F.broadcast(c.agg(F.sum("_cw").alias("_cs"))))
    a = assets.join(vol, "symbol", "left").withColumn("_w", F.lit(1.0) if within_cluster in equal else inverse("vol"))
    a = durable(a.withColumn("_w", F.coalesce("_w", F.lit(0.0))))
    inside = a.groupBy("cluster").agg(F.sum("_w").alias("_ws"))
    a = a.join(inside, "cluster").join(c, "cluster")
    w = F.coalesce(ratio("_w", "_ws"), F.lit(0.0)) * F.coalesce(ratio("_cw", "_cs"), F.lit(0.0))
    w = F.greatest(w, F.lit(float(min_weight)))
    if max_weight is not None:
        w = F.least(w, F.lit(float(max_weight)))
    a = durable(a.withColumn("_raw", w))
    risk = F.col("weight") * F.col("weight") * F.coalesce(F.col("vol") * F.col("vol"), F.lit(0.0))
    a = a.join(F.broadcast(a.agg(F.sum("_raw").alias("_rs")))).withColumn("weight", F.coalesce(ratio("_raw", "_rs"), F.lit(0.0)))
    a = a.withColumn("_risk", risk)
    a = a.join(F.broadcast(a.agg(F.sum("_risk").alias("_var"))))
    share = F.when(F.col("_var") > 0, F.col("_risk") / (F.col("_var") + eps)).otherwise(0.0)
    return a.select("symbol", "weight", "cluster", "vol", share.alias("risk_contrib_diag"))
