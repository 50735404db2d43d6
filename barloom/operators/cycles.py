"""Dominant cycles, autoregression and spectral trade gates.

Rolling kernels run on blocks of a series: a block carries the rows its windows or filters
reach beyond its edge, NumPy evaluates all windows of the block at once, and only the
block's own rows are returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import finite
from barloom.operators.conditions import trailing_bars
from barloom.operators.layout import BLOCK, over_blocks, with_halo
from barloom.session import attach

KERNEL_BLOCK = 1024

# ---- whole-window spectrum, built-ins only -----------------------------------------------------


def detrended(rows: DataFrame, value: str, *, pos: str, method: str = "linear", key=("symbol",)) -> DataFrame:
    """Adds ``detrended``: minus the mean, or minus the least-squares line over the rows with a
    value (the mean when there are fewer than three)."""
    if method in ("none", "off"):
        return rows.withColumn("detrended", F.col(value))
    v = F.col(value)
    t = F.when(v.isNotNull(), F.col(pos).cast("double"))
    fit = rows.groupBy(*key).agg(
        F.avg(v).alias("_m"), F.regr_slope(v, t).alias("_a"), F.regr_intercept(v, t).alias("_b"), F.count(v).alias("_c")
    )
    line = F.col("_a") * F.col(pos) + F.col("_b")
    trend = F.col("_m") if method in ("mean", "constant") else F.when(F.col("_c") >= 3, line).otherwise(F.col("_m"))
    return attach(rows, fit, key).withColumn("detrended", v - trend).drop("_m", "_a", "_b", "_c")


def dominant_cycles(
    bars: DataFrame, *, value: str = "close", window: int = 256, top_k: int = 3, min_period: float = 5.0,
    max_period: float | None = None, detrend: str = "linear", taper: str = "hann",
) -> DataFrame:
    """Strongest cycles of the last ``window`` values as rows (symbol, k, period, ...).

    The Fourier sum is an aggregate: at most ``window`` rows per symbol meet at most
    ``window / 2`` frequencies, and partial sums leave the map side.
    """
    x = trailing_bars(bars.where(F.col(value).isNotNull()), window)
    size = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("bar_no").alias("_from")).where("n >= 32")
    x = x.join(size, "symbol").withColumn("_t", (F.col("bar_no") - F.col("_from")).cast("double"))
    x = detrended(x, value, pos="_t", method=detrend)
    base = {"hann": (0.5, 0.5), "hanning": (0.5, 0.5), "hamm": (0.54, 0.46), "hamming": (0.54, 0.46)}.get(taper)
    if base:
        x = x.withColumn("detrended", F.col("detrended") * (base[0] - base[1] * F.cos(2 * math.pi * F.col("_t") / (F.col("n") - 1))))
    longest = F.lit(float(max_period)) if max_period is not None else F.col("n").cast("double")
    x = x.withColumn("freq_no", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int"))))
    period = F.col("n") / F.col("freq_no")
    x = x.where((period >= min_period) & (period <= longest))
    # the angle is reduced in whole numbers first, which keeps it exact
    angle = 2 * math.pi * F.pmod(F.col("_t").cast("long") * F.col("freq_no"), F.col("n")) / F.col("n")
    s = x.groupBy("symbol", "n", "freq_no").agg(
        F.sum(F.col("detrended") * F.cos(angle)).alias("re"), F.sum(-F.col("detrended") * F.sin(angle)).alias("im")
    )
    s = s.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    w = Window.partitionBy("symbol").orderBy(F.desc("power"), F.desc("freq_no"))
    s = s.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_k)
    return s.select(
        "symbol", "k", (F.col("n") / F.col("freq_no")).alias("period"), (F.col("freq_no") / F.col("n")).alias("frequency"),
        "power", (2.0 * F.sqrt("power") / F.col("n")).alias("amplitude"), F.atan2("im", "re").alias("phase"),
    )


# ---- halo-block kernels ------------------------------------------------------------------------


def _on_blocks(
    rows: DataFrame, value: str, kernel: Callable[[np.ndarray, int], np.ndarray], *, out: str, out_type: str, back: int,
    ahead: int = 0, block: int = KERNEL_BLOCK,
) -> DataFrame:
    """kernel(values, position of the first value) -> one result per value."""
    x = with_halo(rows.select("symbol", "ts", "bar_no", F.col(value).alias("_x")), back, ahead, block=block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_no")
        values = pdf["_x"].to_numpy(dtype=float, na_value=np.nan)
        pdf[out] = kernel(values, int(pdf["bar_no"].iloc[0]))
        return pdf.loc[pdf["_own"], ["symbol", "ts", "bar_no", out]]

    return x.groupBy("symbol", "_blk").applyInPandas(run, f"symbol string, ts timestamp_ntz, bar_no long, {out} {out_type}")


def _by_window(fn: Callable[[np.ndarray], np.ndarray], w: int, empty) -> Callable[[np.ndarray, int], np.ndarray]:
    def kernel(x: np.ndarray, first: int) -> np.ndarray:
        res = np.full(x.size, empty, dtype=object if empty is None else type(empty))
        if x.size >= w:
            res[w - 1 :] = fn(sliding_window_view(x, w))
        return res

    return kernel


def _periods(win: np.ndarray, min_period: float, max_period: float, detrend: str) -> np.ndarray:
    n = win.shape[1]
    t = np.arange(n, dtype=float)
    x = win
    if detrend == "linear":
        tc = t - t.mean()
        slope = (x @ tc) / (tc @ tc)
        x = x - x.mean(axis=1, keepdims=True) - slope[:, None] * tc
    elif detrend in ("mean", "constant"):
        x = x - x.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(x * np.hanning(n), axis=1))[:, 1:] ** 2
    periods = 1.0 / np.fft.rfftfreq(n)[1:]
    ok = (periods >= min_period) & (periods <= max_period)
    if not ok.any():
        return np.full(len(win), np.nan)
    p = periods[ok]
    return p[::-1][np.argmax(power[:, ok][:, ::-1], axis=1)]


def rolling_dominant_period(
    bars: DataFrame, *, value: str = "close", window: int = 128, min_period: float = 5.0, max_period: float | None = None,
    detrend: str = "linear", block: int = KERNEL_BLOCK,
) -> DataFrame:
    """Strongest period of each full trailing window; NULL before, and always for windows under 32."""
    longest = float(max_period) if max_period is not None else None

    def fn(win: np.ndarray) -> np.ndarray:
        res = np.full(len(win), np.nan)
        whole = np.isfinite(win).all(axis=1)
        if window >= 32 and whole.any():
            res[whole] = _periods(win[whole], min_period, longest or float(window), detrend)
        for i in np.flatnonzero(~whole):
            x = win[i][np.isfinite(win[i])]
            if x.size >= 32:
                res[i] = _periods(x[None, :], min_period, longest or float(x.size), detrend)[0]
        return np.where(np.isfinite(res), res, None)

    return _on_blocks(bars, value, _by_window(fn, window, None), out="period", out_type="double", back=window - 1, block=block)


def fft_gate(bars: DataFrame, *, window: int = 128, min_period: float = 10.0, max_period: float = 80.0, block: int = KERNEL_BLOCK) -> DataFrame:
    p = rolling_dominant_period(bars, window=window, min_period=min_period, max_period=max_period, block=block)
    return p.select("symbol", "ts", "bar_no", F.col("period").isNotNull().alias("ok"))


def centred_returns(bars: DataFrame, *, trailing: int | None = None, block: int = BLOCK) -> DataFrame:
    """Log returns of the floored close, missing ones 0, minus the symbol's mean (column x).
    ``trailing`` takes the mean of the last so many bars instead, which looks at no later bar."""
    floored = F.greatest(F.col("close"), F.lit(1e-12))
    r = over_blocks(bars, lambda f: {"_r": F.ln(floored) - F.ln(f.lag(floored))}, back=1, block=block)
    r = r.withColumn("_r", F.coalesce(finite("_r"), F.lit(0.0)))
    if trailing:
        r = over_blocks(r, lambda f: {"_m": F.avg("_r").over(f.last(trailing))}, back=trailing, block=block)
        return r.select("symbol", "ts", "bar_no", (F.col("_r") - F.col("_m")).alias("x"))
    mean = r.groupBy("symbol").agg(F.avg("_r").alias("_m"))
    return attach(r, mean).select("symbol", "ts", "bar_no", (F.col("_r") - F.col("_m")).alias("x"))


# fixed values: Daubechies scaling filters, by number of vanishing moments
DAUBECHIES = {
    2: (0.4829629131445341, 0.8365163037378079, 0.2241438680420134, -0.1294095225512603),
    4: (
        0.2303778133088964, 0.7148465705529154, 0.6308807679298587, -0.02798376941698385,
        -0.1870348117188811, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278,
    ),
    6: (
        0.11154074335008017, 0.4946238903983854, 0.7511339080210954, 0.3152503517091982,
        -0.22626469396516913, -0.12976686756709563, 0.09750160558707936, 0.02752286553001629,
        -0.031582039318031156, 0.0005538422009938016, 0.00477725751094551, -0.0010773010853084796,
    ),
    8: (
        0.05441584224308161, 0.3128715909144659, 0.6756307362972898, 0.5853546836548691,
        -0.015829105256349306, -0.2840155429615824, 0.0004724845739124, 0.12874742662048934,
        -0.017369301001807546, -0.044088253930794755, 0.013981027917015516, 0.008746094047015655,
        -0.00487035299301066, -0.000391740373376947, 0.0006754494059985568, -0.00011747678412476954,
    ),
}


def filter_pair(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass taps and their quadrature mirror."""
    low = np.array(DAUBECHIES[order])
    return low, low[::-1] * np.where(np.arange(low.size) % 2 == 0, 1.0, -1.0)


def detail_energies(win: np.ndarray, order: int) -> np.ndarray:
    """Mean squared detail coefficient per level, for every window (rows) at once."""
    low, high = filter_pair(order)
    levels, a = [], win
    for _ in range(int(math.log2(win.shape[1])) - 1):
        padded = np.pad(a, ((0, 0), (low.size - 1, low.size - 1)), mode="reflect")
        taps = sliding_window_view(padded, low.size, axis=1)[:, ::2]
        levels.append(((taps @ high[::-1]) ** 2).mean(axis=1))
        a = taps @ low[::-1]
        if a.shape[1] < 8:
            break
    return np.stack(levels, axis=1)


def dwt_gate(
    series: DataFrame, *, value: str = "x", window: int = 128, min_period: float = 10.0, max_period: float = 80.0,
    orders: tuple[int, ...] = (2, 4, 6, 8), min_energy_ratio: float = 2.5, block: int = KERNEL_BLOCK,
) -> DataFrame:
    """True where, for some filter, one level with 2^level in the period band carries at least
    the given multiple of the band's median energy."""
    w = max(32, window)
    lo, hi = math.ceil(math.log2(min_period)), math.floor(math.log2(max_period))

    def fn(win: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(win), dtype=bool)
        for o in orders:
            e = detail_energies(win, o)
            level = np.arange(1, e.shape[1] + 1)
            band = e[:, (level >= lo) & (level <= hi)]
            if band.shape[1] >= 2:
                ok |= band.max(axis=1) / (np.median(band, axis=1) + 1e-12) >= min_energy_ratio
        return ok

    return _on_blocks(series, value, _by_window(fn, w, False), out="ok", out_type="boolean", back=w - 1, block=block)


def wavelet(kind: str, period: float) -> np.ndarray:
    """Sampled wavelet of a period, zero mean and unit energy."""
    scale = max(1.0, period * 6.0 / (2.0 * math.pi) if kind == "morlet" else period / 2.0)
    taps = int(min(max(31, 10 * scale), 801))
    u = (np.arange(taps) - (taps - 1) / 2.0) / scale
    shape = np.exp(-0.5 * u * u) * (np.exp(6j * u) if kind == "morlet" else (1.0 - u * u))
    shape = shape - shape.mean()
    return shape / (np.sqrt((np.abs(shape) ** 2).sum()) + 1e-12)


def cwt_gate(
    series: DataFrame, *, value: str = "x", kind: str = "morlet", window: int = 128, min_period: float = 10.0,
    max_period: float = 80.0, n_periods: int = 48, min_power_ratio: float = 1.8, block: int = KERNEL_BLOCK,
) -> DataFrame:
    """True where the strongest of the band's scales has at least the given multiple of the
    median power. The filters are centred, so a row also sees the rows after it."""
    w = max(16, window)
    bank = [wavelet(kind, p) for p in np.linspace(min_period, max_period, max(8, n_periods))]
    reach = max(b.size for b in bank) // 2 + 1
    sized = attach(series, series.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")))
    x = with_halo(sized.select("symbol", "ts", "bar_no", F.col(value).alias("_x"), "_n"), reach, reach, block=block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_no")
        v, n = pdf["_x"].to_numpy(dtype=float), int(pdf["_n"].iloc[0])
        power = np.empty((len(bank), v.size))
        for i, psi in enumerate(bank):
            full = np.convolve(v, np.conjugate(psi[::-1]))
            m = psi.size
            at = (m - 1) // 2 if n >= m else (n - 1) // 2 + (m - n) // 2
            power[i] = np.abs(full[at : at + v.size]) ** 2
        ratio = power.max(axis=0) / (np.median(power, axis=0) + 1e-12)
        pdf["ok"] = (ratio >= min_power_ratio) & (pdf["bar_no"].to_numpy() >= w - 1) & (n >= w)
        return pdf.loc[pdf["_own"], ["symbol", "ts", "bar_no", "ok"]]

    return x.groupBy("symbol", "_blk").applyInPandas(run, "symbol string, ts timestamp_ntz, bar_no long, ok boolean")


def kernel_gate(series: DataFrame, kernel: str, *, threshold: float = 2.5, **band) -> DataFrame:
    """Gate by kernel name: dwt_db2/4/6/8, cwt_morlet, cwt_ricker; unknown names never pass."""
    k = kernel.strip().lower()
    if k.startswith("dwt_db"):
        digits = k[len("dwt_db"):]
        return dwt_gate(series, orders=(int(digits) if digits.isdigit() else 8,), min_energy_ratio=threshold, **band)
    for kind, names in (("morlet", {"cwt_morlet", "cwt_morlet2", "morlet", "morlet2"}), ("ricker", {"cwt_ricker", "ricker", "mexh"})):
        if k in names:
            return cwt_gate(series, kind=kind, min_power_ratio=min(threshold, 1.8), **band)
    return series.select("symbol", "ts", "bar_no", F.lit(False).alias("ok"))


def _max_growth(win: np.ndarray, lookback: int, rank: int) -> np.ndarray:
    h = sliding_window_view(win, win.shape[1] - lookback + 1, axis=1)
    x1, x2 = h[:, :, :-1], h[:, :, 1:]
    u, s, vh = np.linalg.svd(x1, full_matrices=False)
    r = max(1, min(rank, u.shape[2]))
    inv = 1.0 / np.where(s[:, :r] == 0.0, 1e-12, s[:, :r])
    small = np.swapaxes(u[:, :, :r], 1, 2) @ x2 @ np.swapaxes(vh[:, :r], 1, 2) * inv[:, None, :]
    with np.errstate(divide="ignore"):
        return np.log(np.abs(np.linalg.eigvals(small))).max(axis=1)


def dmd_gate(rows: DataFrame, *, value: str = "ret", window: int = 60, lookback: int = 10, rank: int = 3, block: int = KERNEL_BLOCK) -> DataFrame:
    """True where the linear model of the lagged trailing returns does not decay."""

    def fn(win: np.ndarray) -> np.ndarray:
        g = _max_growth(np.nan_to_num(win), lookback, rank)
        return np.isfinite(g) & (g >= 0.0)

    return _on_blocks(rows, value, _by_window(fn, window, False), out="ok", out_type="boolean", back=window - 1, block=block)


# ---- autoregression ----------------------------------------------------------------------------


def _with_lags(rows: DataFrame, value: str, p: int, block: int) -> DataFrame:
    x = F.coalesce(F.col(value), F.lit(0.0))
    return over_blocks(rows, lambda f: {f"_l{k}": (x if k == 0 else f.lag(x, k)) for k in range(p + 1)}, back=p, block=block)


def ar_sums(rows: DataFrame, *, value: str = "ret", p: int = 5, train: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Normal-equation sums per symbol over the training rows with all lags."""
    x = _with_lags(rows, value, p, block).where(F.col("bar_no") >= p)
    if train is not None:
        x = x.where(train)
    sums = [F.sum(F.col(f"_l{i}") * F.col(f"_l{j}")).alias(f"s{i}_{j}") for i in range(p + 1) for j in range(i, p + 1) if j > 0]
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *sums)


def ar_coefficients(rows: DataFrame, *, value: str = "ret", p: int = 5, ridge: float = 1e-6, train: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(symbol, beta) by ridge least squares; NULL for too few rows. The solver sees one row
    of sums per symbol."""
    sums = ar_sums(rows, value=value, p=p, train=train, block=block)
    size = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("_rows"))

    def solve(batches):
        for pdf in batches:
            betas = []
            for r in pdf.to_dict("records"):
                if r["_rows"] < p + 20 or r["n"] < p + 10:
                    betas.append(None)
                    continue
                a = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(1, p + 1)] for i in range(1, p + 1)])
                b = np.array([r[f"s0_{j}"] for j in range(1, p + 1)])
                betas.append(np.linalg.solve(a + ridge * np.eye(p), b).tolist())
            yield pd.DataFrame({"symbol": pdf["symbol"], "beta": betas})

    return sums.join(size, "symbol").mapInPandas(solve, "symbol string, beta array<double>")


def ar_residuals(rows: DataFrame, betas: DataFrame, *, value: str = "ret", p: int = 5, block: int = BLOCK) -> DataFrame:
    """Adds resid: 0 for the first p rows; the value itself where a symbol has no coefficients."""
    x = attach(_with_lags(rows, value, p, block), betas, how="left")
    fitted = sum((F.get("beta", F.lit(k - 1)) * F.col(f"_l{k}") for k in range(1, p + 1)), F.lit(0.0))
    resid = F.when(F.col("beta").isNull(), F.col("_l0")).when(F.col("bar_no") < p, F.lit(0.0)).otherwise(F.col("_l0") - fitted)
    return x.withColumn("resid", resid).drop("beta", *[f"_l{k}" for k in range(p + 1)])


def naive_forecast(series: DataFrame, steps: int = 5, *, value: str = "close") -> DataFrame:
    last = series.groupBy("symbol").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("bar_no"))).alias("_v"))
    return last.select("symbol", F.array_repeat("_v", steps).alias("forecast"))


def ar_forecast(
    series: DataFrame, steps: int = 5, *, value: str = "close", p: int = 3, differenced: bool = True, min_rows: int = 50, block: int = BLOCK
) -> DataFrame:
    """Iterated autoregressive forecast of the (differenced) series per symbol; the last value
    repeated when there are fewer than ``min_rows`` values."""
    s = series.where(F.col(value).isNotNull()).select("symbol", "ts", "bar_no", F.col(value).alias("_v"))
    d = over_blocks(s, lambda f: {"_d": F.col("_v") - f.lag("_v") if differenced else F.col("_v")}, back=1, block=block)
    beta = ar_coefficients(d, value="_d", p=p, block=block)
    tail = trailing_bars(d, p).groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct(F.col("bar_no"), F.coalesce("_d", F.lit(0.0)).alias("d")))).alias("_t"),
        F.max_by("_v", "bar_no").alias("_last"), F.max("n_bars").alias("_n"),
    )
    # newest difference first, to meet beta's order
    t = tail.join(beta, "symbol", "left").withColumn("_lags", F.reverse(F.transform("_t", lambda e: e["d"])))
    start = F.struct(F.col("_lags").alias("lags"), F.col("_last").alias("level"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        parts = F.zip_with(acc["lags"], "beta", lambda a, b: a * b)
        nxt = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
        level = acc["level"] + nxt if differenced else nxt
        return F.struct(
            F.slice(F.concat(F.array(nxt), acc["lags"]), 1, p).alias("lags"), level.alias("level"),
            F.concat(acc["out"], F.array(level)).alias("out"),
        )

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["out"])
    enough = (F.col("_n") >= min_rows) & F.col("beta").isNotNull()
    return t.select("symbol", F.when(enough, path).otherwise(F.array_repeat("_last", steps)).alias("forecast"))
