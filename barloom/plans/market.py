"""Market summary: one row per symbol from all analysis operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import conditions as cond
from barloom.operators import indicators as ind
from barloom.operators.cycles import ar_forecast, dominant_cycles, rolling_dominant_period
from barloom.session import attach


def enriched(bars: DataFrame) -> DataFrame:
    """Bars with RSI, Ichimoku lines and both cloud edges."""
    return ind.rsi(ind.ichimoku(bars)).drop("chikou")


def with_cycle_columns(bars: DataFrame, *, window: int = 128, top_k: int = 3) -> DataFrame:
    """Bars with the rolling dominant period and the last window's strongest cycles as columns.

    The latter are constants per symbol computed from the whole history; keep them out of
    features unless that look-ahead is wanted."""
    per = rolling_dominant_period(bars, window=window).select("symbol", "bar_no", F.col("period").alias("fft_period"))
    one = lambda k, c, name: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{name}{k}")
    cols = [one(k, c, n) for k in range(1, top_k + 1) for c, n in (("period", "fft_period"), ("power", "fft_power"), ("amplitude", "fft_amp"))]
    top = dominant_cycles(bars, top_k=top_k).groupBy("symbol").agg(*cols)
    return attach(bars.join(per, ["symbol", "bar_no"], "left"), top, how="left")


def summary(bars: DataFrame, *, interval: str = "1d", steps: int = 5, top_k: int = 3) -> DataFrame:
    """Last close, regime, levels, trade style, forecast and dominant cycles."""
    last = cond.latest(ind.regime(bars), ["ts", "close", "regime"])
    levels = cond.support_resistance(bars).groupBy("symbol").pivot("kind", ["support", "resistance"]).agg(
        F.array_sort(F.collect_list("level"))
    )
    cycles = dominant_cycles(bars, top_k=top_k).groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("k", "period", "frequency", "power", "amplitude", "phase"))).alias("cycles")
    )
    out = last.join(cond.trade_style(bars, interval), "symbol", "left")
    for part in (levels, ar_forecast(bars, steps), cycles):
        out = out.join(part, "symbol", "left")
    return out.select("symbol", "ts", F.col("close").alias("last_close"), "regime", "style", "support", "resistance", "forecast", "cycles")
