"""Latest-bar conditions, price levels and chart selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators import indicators as ind
from barloom.operators.layout import BLOCK
from barloom.session import attach

# fixed values: retracement ratios
FIB_RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)


def trailing_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol with ``n_bars``; a filter, so that windows above it stay small."""
    size = bars.groupBy("symbol").agg((F.max("bar_no") + 1).alias("n_bars"))
    return attach(bars, size).where(F.col("bar_no") >= F.col("n_bars") - n)


def latest(df: DataFrame, cols: Sequence[str], *, only: Column | None = None) -> DataFrame:
    """Values of each symbol's last row (or last row that satisfies ``only``)."""
    at = F.col("bar_no") if only is None else F.when(only, F.col("bar_no"))
    best = df.groupBy("symbol").agg(F.max_by(F.struct(*cols), at).alias("_r"))
    return best.select("symbol", "_r.*")


def trade_style(bars: DataFrame, interval: str) -> DataFrame:
    """day/scalp for minute and hour bars, swing/long above, by the last ATR relative to close."""
    last = latest(ind.atr_wilder(bars), ["close", "atr_14"])
    share = ratio("atr_14", "close")
    fast = interval.endswith(("m", "h"))
    cut, wild, calm = (0.015, "day", "scalp") if fast else (0.04, "swing", "long")
    return last.select(
        "symbol", share.alias("atr_over_close"), F.when(share >= cut, wild).otherwise(calm).alias("style")
    )


def merged_levels(points: DataFrame, *, tolerance: float = 0.003, key: Sequence[str] = ("symbol", "kind")) -> DataFrame:
    """Merge nearby price levels, from low to high, into running pair means.

    A level joins the one below when it lies within ``tolerance`` of its current mean.
    Equal prices are counted first: c copies move the mean m to x - (x - m) / 2^c. A gap
    wider than the tolerance to the next price always starts a new level, because the
    mean never exceeds the last price; the runs between such gaps are folded on their own.
    """
    counted = points.groupBy(*key, "level").agg(F.count(F.lit(1)).alias("copies"))
    w = Window.partitionBy(*key).orderBy("level")
    prev = F.lag("level").over(w)
    apart = F.when(prev.isNull() | (ratio(F.col("level") - prev, F.greatest(prev, F.lit(1e-9))) > tolerance), 1).otherwise(0)
    runs = counted.withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(w))
    folded = runs.groupBy(*key, "_run").agg(
        F.array_sort(F.collect_list(F.struct("level", "copies"))).alias("_pts")
    )
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(None).cast("double").alias("m"))

    def step(acc: Column, p: Column) -> Column:
        x, m = p["level"], acc["m"]
        near = F.abs(x - m) / F.greatest(F.lit(1e-9), m) <= tolerance
        return (
            F.when(m.isNull(), F.struct(acc["done"].alias("done"), x.alias("m")))
            .when(near, F.struct(acc["done"].alias("done"), (x - (x - m) * F.pow(F.lit(0.5), p["copies"])).alias("m")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(m)).alias("done"), x.alias("m")))
        )

    levels = F.aggregate("_pts", start, step, lambda acc: F.concat(acc["done"], F.array(acc["m"])))
    return folded.select(*key, F.explode(levels).alias("level"))


def support_resistance(
    bars: DataFrame, *, window: int = 5, max_levels: int = 6, tolerance: float = 0.003, block: int = BLOCK
) -> DataFrame:
    """Highest supports and lowest resistances as rows (symbol, kind, level_no, level)."""
    p = ind.pivots(bars, window, block=block)
    points = p.select(
        "symbol",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.col("pivot_low"), F.struct(F.lit("support").alias("kind"), F.col("low").alias("level"))),
                    F.when(F.col("pivot_high"), F.struct(F.lit("resistance").alias("kind"), F.col("high").alias("level"))),
                )
            )
        ),
    )
    levels = merged_levels(points, tolerance=tolerance)
    signed = F.when(F.col("kind") == "support", -F.col("level")).otherwise(F.col("level"))
    w = Window.partitionBy("symbol", "kind").orderBy(signed)
    return (
        levels.withColumn("level_no", F.row_number().over(w)).where(F.col("level_no") <= max_levels)
        .select("symbol", "kind", "level_no", "level")
    )


def fibonacci(bars: DataFrame, *, lookback: int = 60, tolerance: float = 0.01) -> DataFrame:
    """Nearest retracement of the last swing; passes within the tolerance."""
    n = lookback if lookback > 5 else 60
    swing = trailing_bars(bars, n).where(F.col("n_bars") >= 5).groupBy("symbol").agg(
        F.max("high").alias("swing_high"), F.min("low").alias("swing_low"), F.max_by("close", "bar_no").alias("close")
    ).where((F.col("swing_high") > F.col("swing_low")) & (F.col("close") > 0))
    span = F.col("swing_high") - F.col("swing_low")
    options = F.array(
        *[
            F.struct(
                (F.abs(F.col("close") - (F.col("swing_high") - r * span)) / F.col("close")).alias("dist"),
                F.lit(i).alias("i"),
                F.lit(r).alias("ratio"),
                (F.col("swing_high") - r * span).alias("level"),
            )
            for i, r in enumerate(FIB_RATIOS)
        ]
    )
    best = F.array_min(options)
    return swing.select(
        "symbol", "swing_high", "swing_low", "close",
        best["ratio"].alias("nearest_ratio"), best["level"].alias("nearest_level"), best["dist"].alias("dist"),
        (best["dist"] <= tolerance).alias("fib_ok"),
    )


def ichimoku_signal(bars: DataFrame) -> DataFrame:
    """Direction on the latest bar against the cloud; needs 80 bars."""
    # row numbers stay those of the full series, so cut off only what no frame can reach
    recent = trailing_bars(bars, 120)
    last = latest(ind.ichimoku(recent), ["n_bars", "close", "tenkan", "kijun", "senkou_a", "senkou_b"])
    c, t, k, a, b = (F.col(x) for x in ("close", "tenkan", "kijun", "senkou_a", "senkou_b"))
    ready = (F.col("n_bars") >= 80) & t.isNotNull() & k.isNotNull() & a.isNotNull() & b.isNotNull()
    long_ok = (c > F.greatest(a, b)) & (t > k) & (a >= b)
    short_ok = (c < F.least(a, b)) & (t < k) & (a <= b)
    direction = F.when(ready & long_ok, "long").when(ready & short_ok, "short")
    return last.select(
        "symbol", "close", "tenkan", "kijun", "senkou_a", "senkou_b",
        direction.alias("direction"), direction.isNotNull().alias("ichimoku_ok"),
    )


def rsi_ok(value: Column, direction: Column) -> Column:
    return F.coalesce(
        F.when(direction == "long", value.between(50, 70))
        .when(direction == "short", value.between(30, 50))
        .otherwise(value.between(45, 55)),
        F.lit(False),
    )


def rsi_condition(bars: DataFrame, directions: DataFrame) -> DataFrame:
    """Last known RSI against the band of the direction; needs 20 bars."""
    r = ind.rsi(bars)
    last = r.groupBy("symbol").agg(
        F.max_by("rsi_14", F.when(F.col("rsi_14").isNotNull(), F.col("bar_no"))).alias("rsi_14"),
        (F.max("bar_no") + 1).alias("_n"),
    )
    value = F.when(F.col("_n") >= 20, F.col("rsi_14"))
    return last.join(directions.select("symbol", "direction"), "symbol", "left").select(
        "symbol", value.alias("rsi_14"), rsi_ok(value, F.col("direction")).alias("rsi_ok")
    )


def recent_news(items: DataFrame, as_of: Column, *, days: int = 7, min_items: int = 1) -> DataFrame:
    """Items per symbol dated within the last days; items carry (symbol, ts)."""
    fresh = F.col("ts") >= as_of - F.expr(f"INTERVAL '{days}' DAY")
    return items.groupBy("symbol").agg(F.count_if(fresh).alias("news_items")).withColumn(
        "news_ok", F.col("news_items") >= min_items
    )


def condition_scores(bars: DataFrame, news: DataFrame | None = None, *, lookback: int = 60, tolerance: float = 0.01) -> DataFrame:
    """Conditions met out of four; without a news table that condition is NULL and the divisor stays four."""
    ichi = ichimoku_signal(bars).select("symbol", "direction", "ichimoku_ok")
    fib = fibonacci(bars, lookback=lookback, tolerance=tolerance).select("symbol", "fib_ok", "nearest_ratio")
    out = ichi.join(rsi_condition(bars, ichi), "symbol", "left").join(fib, "symbol", "left")
    if news is None:
        out = out.withColumns({"news_ok": F.lit(None).cast("boolean"), "news_items": F.lit(0).cast("long")})
    else:
        out = out.join(news.select("symbol", "news_items", "news_ok"), "symbol", "left")
        out = out.withColumns(
            {"news_ok": F.coalesce("news_ok", F.lit(False)), "news_items": F.coalesce("news_items", F.lit(0))}
        )
    flags = ["ichimoku_ok", "rsi_ok", "news_ok", "fib_ok"]
    met = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags), F.lit(0))
    out = out.withColumns({"rsi_ok": F.coalesce("rsi_ok", F.lit(False)), "fib_ok": F.coalesce("fib_ok", F.lit(False))})
    return out.withColumn("conditions_met", met).withColumn("score", F.col("conditions_met") / 4.0)


def select_charts(scored: DataFrame, *, min_conditions: int, max_selected: int | None = None, pos: str = "pos") -> DataFrame:
    """Best charts first; equal ones keep their input order."""
    out = scored.where(F.col("conditions_met") >= min_conditions).orderBy(
        F.desc("conditions_met"), F.desc("score"), F.asc(pos)
    )
    return out.limit(max_selected) if max_selected else out


def not_selected(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    return scored.select("symbol").exceptAll(chosen.select("symbol"))
