"""Time x asset x feature tensor, its decompositions, and dynamic modes of a panel.

The tensor is a long table of cells, and so are all factors: a step joins cells with factor tables and sums by key. Only
matrices of the rank's size reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators import graphs
from barloom.operators.indicators import liquidity, realized_vol
from barloom.operators.joins import calendar
from barloom.operators.layout import BLOCK
from barloom.session import durable, small, stored

FEATURES = ("returns", "rv", "depth", "dollar_volume", "hl_range")


def tensor_long(
    bars: DataFrame, features: tuple[str, ...] = ("returns", "rv", "depth"), *, vol_window: int = 20, depth: str | None = None,
    strict: bool = False, block: int = BLOCK,
) -> DataFrame:
    """(ts, symbol, feature, z): features with data for two assets, assets with data for all of
    those features, z-scored per feature over time and assets, missing values 0. Absent rows
    count as 0. ``strict`` keeps only timestamps where every feature of every asset is known."""
    x = realized_vol(liquidity(bars, depth), vol_window, block=block)
    names = {"returns": "log_ret", "rv": "rv", "depth": "depth", "dollar_volume": "dollar_volume", "hl_range": "hl_range"}
    wanted = [f for f in features if f in names and names[f] in x.columns]
    long = x.select("ts", "symbol", *[F.col(names[f]).alias(f) for f in wanted]).unpivot(
        ["ts", "symbol"], wanted, "feature", "value"
    )
    long = durable(long)
    filled = long.groupBy("symbol", "feature").agg(F.count("value").alias("_c")).where("_c > 0")
    usable = filled.groupBy("feature").agg(F.count(F.lit(1)).alias("_a")).where("_a >= 2").select("feature")
    filled = filled.join(F.broadcast(usable), "feature", "left_semi")
    whole = filled.groupBy("symbol").agg(F.count(F.lit(1)).alias("_f")).join(F.broadcast(usable.agg(F.count(F.lit(1)).alias("_nf"))))
    assets = whole.where("_f = _nf").select("symbol")
    t = long.join(F.broadcast(usable), "feature", "left_semi").join(small(assets), "symbol", "left_semi")
    if strict:
        n = assets.agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(usable.agg(F.count(F.lit(1)).alias("_nf"))))
        full = t.groupBy("ts").agg(F.count("value").alias("_c")).join(F.broadcast(n)).where("_c = _n * _nf")
        t = t.join(full.select("ts"), "ts", "left_semi")
    scale = t.groupBy("feature").agg(F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd"))
    sd = F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(1.0)
    return t.join(F.broadcast(scale), "feature").select(
        "ts", "symbol", "feature", F.coalesce((F.col("value") - F.col("_mu")) / sd, F.lit(0.0)).alias("z")
    )


MODES = ("ts", "symbol", "feature")


@dataclass
class Factors:
    """A table (key, x: numbers) for each mode, the key named after the mode, and the relative error after each sweep."""

    time: DataFrame
    asset: DataFrame
    feature: DataFrame
    errors: list[float]


def _times(x: Column, m: np.ndarray) -> Column:
    """The row x times a small matrix."""
    return F.array(*[sum((x[i] * float(m[i, j]) for i in range(m.shape[0])), F.lit(0.0)) for j in range(m.shape[1])])


def _sums(rows: DataFrame, terms: list[Column]) -> np.ndarray:
    return np.array([v or 0.0 for v in rows.agg(*[F.sum(t).alias(f"s{i}") for i, t in enumerate(terms)]).first()])


def _gram(table: DataFrame, width: int) -> np.ndarray:
    return _sums(table, [F.col("x")[i] * F.col("x")[j] for i in range(width) for j in range(width)]).reshape(width, width)


def _start(table: DataFrame, mode: str, rank: int, seed: int) -> DataFrame:
    """Numbers between -0.5 and 0.5 from a hash of the key, so that they do not depend on an order of the keys."""
    part = lambda r: F.conv(F.substring(F.md5(F.concat(F.col(mode).cast("string"), F.lit(f"/{r + seed * rank}"))), 1, 8), 16, 10).cast("double") / float(1 << 32) - 0.5
    return table.select(mode).distinct().select(mode, F.array(*[part(r) for r in range(rank)]).alias("x"))


def _matricised(cells: DataFrame, mode: str, others: dict[str, DataFrame], rank: int) -> DataFrame:
    """For each key of the mode the sum of z times the product of the other modes' factors, over its cells."""
    rows = cells
    for k, (name, factor) in enumerate(others.items()):
        rows = rows.join(factor.select(name, F.col("x").alias(f"x{k}")), name)
    return rows.groupBy(mode).agg(F.array(*[F.sum(F.col("z") * F.col("x0")[r] * F.col("x1")[r]) for r in range(rank)]).alias("m"))


def cp_decompose(tensor: DataFrame, rank: int = 2, *, sweeps: int = 8, seed: int = 0) -> Factors:
    """Rank-R factors by alternating least squares. A mode's step joins the nonzero cells with the tables of the other two factors
    and sums by the mode's key; only R x R matrices reach the driver. All three factors stay tables, and a table is broadcast
    to the cells only after it was counted."""
    cells = stored(tensor.where("z <> 0").select(*MODES, "z"))
    norm = float(_sums(cells, [F.col("z") * F.col("z")])[0])
    held = {m: graphs.held(_start(cells, m, rank, seed)) for m in MODES[1:]}
    gram = {m: _gram(t, rank) for m, t in held.items()}
    errors = []
    for _ in range(sweeps):
        for mode in MODES:
            others = [m for m in MODES if m != mode]
            inverse = np.linalg.pinv(gram[others[0]] * gram[others[1]])
            moved = _matricised(cells, mode, {m: held[m] for m in others}, rank).withColumn("x", _times(F.col("m"), inverse))
            held[mode] = graphs.held(moved)
            gram[mode] = _gram(held[mode], rank)
        fit = norm - 2 * float(_sums(held[mode], [F.col("x")[r] * F.col("m")[r] for r in range(rank)]).sum())
        fit += float((gram["ts"] * gram["symbol"] * gram["feature"]).sum())
        errors.append(float(np.sqrt(max(fit, 0.0) / norm)) if norm > 0 else 0.0)
    return Factors(*[held[m].select(m, "x") for m in MODES], errors)


def _mode_vectors(cells: DataFrame, mode: str, k: int) -> DataFrame:
    """(key, x): the leading left singular vectors of the tensor unfolded along the mode. The first key with a loading has a
    positive one."""
    at = F.struct(*[m for m in MODES if m != mode])
    nodes = cells.select(F.col(mode).cast("string").alias("node")).distinct()
    values, found = graphs.leading_vectors(
        graphs.gram(cells.select(F.col(mode).alias("node"), at.alias("at"), F.col("z").alias("value"))),
        nodes.select("node", F.lit("all").alias("component"), F.lit(0.0).alias("still")), k)
    return graphs.signed(stored(found), len(values)).select(F.col("node").alias(mode), F.col("v").alias("x"))


def tucker_decompose(tensor: DataFrame, ranks: tuple[int, int, int] = (3, 2, 2)) -> tuple[Factors, np.ndarray]:
    """Higher-order SVD: leading singular vectors of the asset and feature unfoldings by block Krylov steps on the cells, time by
    projection. Returns the factors and the core."""
    cells = stored(tensor.where("z <> 0").select(*MODES, "z"))
    ua, uf = graphs.held(_mode_vectors(cells, "symbol", ranks[1])), graphs.held(_mode_vectors(cells, "feature", ranks[2]))
    ja, jf = (t.select(F.size("x")).first() for t in (ua, uf))
    ja, jf = ja[0] if ja else 0, jf[0] if jf else 0
    width = ja * jf
    rows = cells.join(ua.withColumnRenamed("x", "x0"), "symbol").join(uf.withColumnRenamed("x", "x1"), "feature")
    y = stored(rows.groupBy("ts").agg(F.array(*[F.sum(F.col("z") * F.col("x0")[j] * F.col("x1")[k]) for j in range(ja) for k in range(jf)]).cast("array<double>").alias("x")))
    gram = _gram(y, width)
    values, vectors = np.linalg.eigh(gram) if width else (np.zeros(0), np.zeros((0, 0)))
    v = vectors[:, ::-1][:, : min(ranks[0], width)]
    lead = v[np.argmax(np.abs(v) > 1e-9, axis=0), np.arange(v.shape[1])] if width else np.zeros(0)
    v = v * np.where(lead < 0, -1.0, 1.0)
    size = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", v, gram, v), 1e-300))
    core = (size[:, None] * v.T).reshape(v.shape[1], ja, jf)
    time = y.select("ts", _times(F.col("x"), v / size).cast("array<double>").alias("x"))
    return Factors(time, ua, uf, []), core


NEIGHBOUR_TILE = 1024


def nearest_points(points: DataFrame, k: int, *, tile: int = NEIGHBOUR_TILE) -> DataFrame:
    """(src, dst): the k nearest other points of each point (symbol, x), ties by name. A task compares two tiles of points and
    keeps the k best of each; the best of those over all tiles are the neighbours."""
    points = stored(points.select("symbol", F.col("x").cast("array<double>").alias("x")))
    tiles = max(1, -(-points.count() // tile))
    mine = points.withColumn("ti", F.pmod(F.xxhash64("symbol"), F.lit(tiles)).cast("int"))
    ends = F.sequence(F.lit(0), F.lit(tiles - 1))
    both = mine.select("symbol", "x", "ti", F.explode(ends).alias("tj"), F.lit(True).alias("left")).union(
        mine.select("symbol", "x", F.explode(ends).alias("ti"), F.col("ti").alias("tj"), F.lit(False).alias("left")))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["left"] == side].sort_values("symbol") for side in (True, False))
        if not len(a) or not len(b):
            return pd.DataFrame({"src": [], "dst": [], "d": []})
        x, y = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
        d = np.zeros((len(x), len(y)))
        for c in range(x.shape[1]):
            d += (x[:, c, None] - y[None, :, c]) ** 2
        names, others = a["symbol"].to_numpy(), b["symbol"].to_numpy()
        d[names[:, None] == others[None, :]] = np.inf
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        keep = np.isfinite(np.take_along_axis(d, top, axis=1))
        return pd.DataFrame({"src": np.repeat(names, top.shape[1])[keep.ravel()], "dst": others[top][keep], "d": np.take_along_axis(d, top, axis=1)[keep]})

    near = both.groupBy("ti", "tj").applyInPandas(best, "src string, dst string, d double")
    w = Window.partitionBy("src").orderBy("d", "dst")
    return near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select("src", "dst")


def embed_2d(points: DataFrame, neighbours: int = 5) -> DataFrame:
    """points (symbol, x) -> (symbol, x, y): two Laplacian-eigenmap coordinates over the graph of nearest neighbours. The constant
    vector of each part of the graph is left out; fewer than three points lie at zero."""
    points = stored(points.select("symbol", "x"))
    if points.limit(3).count() < 3:
        return points.select("symbol", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    near = nearest_points(points, neighbours)
    both = near.select("src", "dst").union(near.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = stored(both.groupBy("src", "dst").agg((F.count("*") / 2.0).alias("w")))
    values, vectors = graphs.laplacian_vectors(edges, 2)
    degree = edges.groupBy("src").agg(F.sum("w").alias("degree"))
    scaled = vectors.join(degree, F.col("node") == F.col("src")).select("node", F.transform("v", lambda c: c / F.sqrt("degree")).alias("v"))
    out = graphs.signed(stored(scaled), len(values))
    at = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))
    return out.select(F.col("node").alias("symbol"), at(0).alias("x"), at(1).alias("y"))


def dynamic_modes(returns: DataFrame, rank: int = 6, *, step_seconds: int = 86_400) -> DataFrame:
    """Dynamic modes of a complete panel: (eig_real, eig_imag, growth, frequency, amplitude_abs).

    The leading left singular vectors U of the snapshots come from block Krylov steps on the cells. Snapshots projected on U, of
    ``rank`` numbers a timestamp, give U'X2 X1'U as one sum over time; the modes before the last rotation are a table by
    asset. Only rank x rank matrices reach the driver.
    """
    rows = returns.where(F.col("ret").isNotNull()).join(calendar(returns, step_seconds=step_seconds), "ts").select("symbol", "t_no", F.col("ret").alias("x"))
    rows = stored(rows)
    last = rows.agg(F.max("t_no")).first()[0]
    names = stored(rows.select("symbol").distinct())
    spark = returns.sparkSession
    schema = "eig_real double, eig_imag double, amplitude_abs double"
    if last is None or last < 2:
        return growth_frequency(spark.createDataFrame([], schema))
    before = rows.where(F.col("t_no") < last)
    s2, vectors = graphs.leading_vectors(
        graphs.gram(before.select(F.col("symbol").alias("node"), F.col("t_no").alias("at"), F.col("x").alias("value"))),
        names.select(F.col("symbol").alias("node"), F.lit("all").alias("component"), F.lit(0.0).alias("still")), rank)
    r, s2 = len(s2), np.maximum(s2, 1e-24)
    u = graphs.held(vectors.select(F.col("node").alias("symbol"), F.col("v").alias("u")))
    p = stored(rows.join(u, "symbol").groupBy("t_no").agg(F.array(*[F.sum(F.col("x") * F.col("u")[i]) for i in range(r)]).alias("p")))
    after = p.select((F.col("t_no") - 1).alias("t_no"), F.col("p").alias("q"))
    square = _sums(p.join(after, "t_no"), [F.col("q")[i] * F.col("p")[j] for i in range(r) for j in range(r)]).reshape(r, r)
    lam, w = np.linalg.eig(square / s2)
    moved = rows.select("symbol", (F.col("t_no") - 1).alias("t_no"), "x").join(p, "t_no")
    modes = moved.groupBy("symbol").agg(F.array(*[F.sum(F.col("x") * F.col("p")[i]) / float(s2[i]) for i in range(r)]).alias("x"))
    first = rows.where("t_no = 0").select("symbol", F.col("x").alias("first"))
    modes = stored(modes.join(first, "symbol", "left"))
    gram = _gram(modes, r)
    right = _sums(modes, [F.col("x")[i] * F.coalesce("first", F.lit(0.0)) for i in range(r)])
    amplitude = np.linalg.pinv(w.conj().T @ gram @ w, hermitian=True) @ (w.conj().T @ right)
    table = [(float(v.real), float(v.imag), float(abs(b))) for v, b in zip(lam, amplitude)]
    return growth_frequency(spark.createDataFrame(table, schema)).orderBy(F.desc("amplitude_abs"))


def growth_frequency(eigs: DataFrame, dt: float = 1.0) -> DataFrame:
    """log(eigenvalue) / dt as growth rate and cycles per step."""
    size = F.sqrt(F.col("eig_real") * F.col("eig_real") + F.col("eig_imag") * F.col("eig_imag"))
    return eigs.withColumns(
        {"growth": F.ln(F.when(size > 0, size)) / dt, "frequency": ratio(F.atan2("eig_imag", "eig_real"), F.lit(2 * np.pi * dt))}
    )
