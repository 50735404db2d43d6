"""Technical indicators over numbered bars (symbol, ts, bar_no, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import col, ratio
from barloom.operators.layout import BLOCK, Frame, ewm, over_blocks



def pct_change(f: Frame, x: str | Column, k: int = 1) -> Column:
    prev = f.lag(x, k)
    return ratio(col(x), prev) - 1.0


def log_return(f: Frame, x: str | Column) -> Column:
    return F.ln(col(x)) - F.ln(f.lag(x))


def true_range(f: Frame) -> Column:
    prev = f.lag("close")
    h, lo = F.col("high"), F.col("low")
    return F.greatest(h - lo, F.abs(h - prev), F.abs(lo - prev))


def mid_range(f: Frame, n: int) -> Column:
    return (f.full(F.max, F.col("high"), n) + f.full(F.min, F.col("low"), n)) / 2.0


def returns(bars: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """diff, pct_change over 1 and 5 bars, log return."""
    return over_blocks(
        bars,
        lambda f: {
            "diff_1": F.col("close") - f.lag("close"),
            "ret_1": pct_change(f, "close"),
            "ret_5": pct_change(f, "close", 5),
            "log_ret_1": log_return(f, "close"),
        },
        back=5,
        block=block,
    )


def future_return(bars: DataFrame, horizon: int = 1, *, out: str = "future_ret", block: int = BLOCK) -> DataFrame:
    return over_blocks(
        bars, lambda f: {out: ratio(f.lead("close", horizon), "close") - 1.0}, back=0, ahead=horizon, block=block
    )


def direction_label(ret: str | Column, threshold: float = 0.0) -> Column:
    """1 above the threshold, -1 below its negative, 0 between, NULL without a return."""
    r = col(ret)
    return F.when(r > threshold, 1).when(r < -threshold, -1).when(r.isNotNull(), 0)


def labels(bars: DataFrame, horizon: int = 1, threshold: float = 0.0, *, block: int = BLOCK) -> DataFrame:
    out = future_return(bars, horizon, block=block)
    return out.withColumn("label", direction_label("future_ret", threshold))


def sma(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 50), x: str = "close", *, block: int = BLOCK) -> DataFrame:
    return over_blocks(
        bars, lambda f: {f"sma_{p}": f.full(F.avg, F.col(x), p) for p in periods}, back=max(periods), block=block
    )


def rolling_std(bars: DataFrame, periods: tuple[int, ...] = (10, 20), *, block: int = BLOCK) -> DataFrame:
    """Population deviation of the one-bar return."""
    return over_blocks(
        bars,
        lambda f: {"ret_1": pct_change(f, "close")},
        lambda f: {f"vol_{p}": f.full(F.stddev_pop, F.col("ret_1"), p) for p in periods},
        back=max(periods) + 1,
        block=block,
    )


def realized_vol(bars: DataFrame, window: int = 20, *, block: int = BLOCK) -> DataFrame:
    """Sample deviation of log returns once max(5, window // 2) of them are present."""
    need = max(5, window // 2)
    return over_blocks(
        bars,
        lambda f: {"log_ret": log_return(f, "close")},
        lambda f: {"rv": f.full(F.stddev_samp, F.col("log_ret"), window, need)},
        back=window + 1,
        block=block,
    )


def atr_simple_prior(bars: DataFrame, window: int = 14, *, block: int = BLOCK) -> DataFrame:
    """Mean true range of the bars before this one; what a stop may know."""
    return over_blocks(
        bars,
        lambda f: {"tr": true_range(f)},
        lambda f: {"_atr": f.full(F.avg, F.col("tr"), window)},
        lambda f: {"atr_prev": f.lag("_atr")},
        back=window + 2,
        block=block,
    ).drop("_atr")


def ichimoku(
    bars: DataFrame, tenkan: int = 9, kijun: int = 26, senkou: int = 52, shift: int = 26, *, block: int = BLOCK
) -> DataFrame:
    return over_blocks(
        bars,
        lambda f: {
            "tenkan": mid_range(f, tenkan),
            "kijun": mid_range(f, kijun),
            "_b": mid_range(f, senkou),
            "chikou": f.lead("close", shift),
        },
        lambda f: {
            "senkou_a": f.lag((F.col("tenkan") + F.col("kijun")) / 2.0, shift),
            "senkou_b": f.lag("_b", shift),
        },
        back=max(tenkan, kijun, senkou) + shift,
        ahead=shift,
        block=block,
    ).drop("_b")


def bollinger(bars: DataFrame, window: int = 20, width: float = 2.0, *, block: int = BLOCK) -> DataFrame:
    def bands(f: Frame) -> dict[str, Column]:
        mid, dev = f.full(F.avg, F.col("close"), window), f.full(F.stddev_pop, F.col("close"), window)
        return {"bb_mid": mid, "bb_upper": mid + width * dev, "bb_lower": mid - width * dev}

    out = over_blocks(bars, bands, back=window, block=block)
    span = F.col("bb_upper") - F.col("bb_lower")
    return out.withColumns({"bb_width": ratio(span, "bb_mid"), "bb_pos": ratio(F.col("close") - F.col("bb_lower"), span)})


def volume_ratio(bars: DataFrame, window: int = 20, *, block: int = BLOCK) -> DataFrame:
    out = over_blocks(bars, lambda f: {"volume_sma_20": f.full(F.avg, F.col("volume"), window)}, back=window, block=block)
    return out.withColumn("volume_over_sma_20", ratio("volume", "volume_sma_20") - 1.0)


def candle_columns() -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = h - lo
    return {
        "range": rng,
        "body": c - o,
        "body_abs": F.abs(c - o),
        "upper_wick": h - F.greatest(o, c),
        "lower_wick": F.least(o, c) - lo,
        "body_to_range": ratio(F.abs(c - o), rng),
    }


def candles(bars: DataFrame) -> DataFrame:
    return bars.withColumns(candle_columns())


def regime(bars: DataFrame, short: int = 50, long: int = 200, *, block: int = BLOCK) -> DataFrame:
    """bull or bear by two means; neutral without both; NULL when they are equal."""
    out = over_blocks(
        bars,
        lambda f: {"_s": f.full(F.avg, F.col("close"), short), "_l": f.full(F.avg, F.col("close"), long)},
        back=long,
        block=block,
    )
    s, lg = F.col("_s"), F.col("_l")
    label = F.when(s.isNull() | lg.isNull(), "neutral").when(s > lg, "bull").when(s < lg, "bear")
    return out.withColumn("regime", label).drop("_s", "_l")


def pivots(bars: DataFrame, window: int = 5, *, block: int = BLOCK) -> DataFrame:
    """Rows whose high (low) is the extreme of the rows around them."""

    def build(f: Frame) -> dict[str, Column]:
        whole = f.lag("bar_no", window).isNotNull() & f.lead("bar_no", window).isNotNull()
        return {
            "pivot_high": whole & (F.col("high") == F.max("high").over(f.around(window))),
            "pivot_low": whole & (F.col("low") == F.min("low").over(f.around(window))),
        }

    return over_blocks(bars, build, back=window, ahead=window, block=block)


def liquidity(bars: DataFrame, depth: str | None = None) -> DataFrame:
    """Dollar volume, relative range and, if the bars carry one, order-book depth."""
    found = depth or next((c for c in bars.columns if "depth" in c.lower() or "orderbook" in c.lower()), None)
    extra = {"depth": F.col(found)} if found else {}
    return bars.withColumns(
        {"dollar_volume": F.col("close") * F.col("volume"), "hl_range": ratio(F.col("high") - F.col("low"), "close"), **extra}
    )


# ---- recursive means ---------------------------------------------------------------------


def ema_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def ema(bars: DataFrame, spans: tuple[int, ...], x: str = "close", *, block: int | None = None) -> DataFrame:
    return ewm(bars, {f"ema_{s}": (x, ema_alpha(s), s) for s in spans}, block=block)


def _rsi_inputs(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    def build(f: Frame) -> dict[str, Column]:
        d = F.col("close") - f.lag("close")
        return {
            "_gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))),
            "_loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))),
            "_tr": true_range(f),
        }

    return over_blocks(bars, build, back=1, block=block)


def _rsi_value(gain: str = "_avg_gain", loss: str = "_avg_loss") -> Column:
    return 100.0 - 100.0 / (1.0 + ratio(gain, loss))


def rsi(bars: DataFrame, period: int = 14, *, block: int | None = None) -> DataFrame:
    """Wilder RSI; NULL while there was no loss at all."""
    a = 1.0 / period
    out = ewm(
        _rsi_inputs(bars).drop("_tr"),
        {"_avg_gain": ("_gain", a, period), "_avg_loss": ("_loss", a, period)},
        block=block,
    )
    return out.withColumn(f"rsi_{period}", _rsi_value()).drop("_gain", "_loss", "_avg_gain", "_avg_loss")


def atr_wilder(bars: DataFrame, period: int = 14, *, block: int | None = None) -> DataFrame:
    out = ewm(_rsi_inputs(bars).drop("_gain", "_loss"), {f"atr_{period}": ("_tr", 1.0 / period, period)}, block=block)
    return out.withColumnRenamed("_tr", "tr")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, *, block: int | None = None) -> DataFrame:
    out = ewm(bars, {"_f": ("close", ema_alpha(fast), fast), "_s": ("close", ema_alpha(slow), slow)}, block=block)
    out = out.withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s")
    out = ewm(out, {"macd_signal": ("macd", ema_alpha(signal), signal)}, block=block)
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


# ---- feature matrix ----------------------------------------------------------------------

SMA_PERIODS = (10, 20, 50, 100, 200)
EMA_SPANS = (12, 26)

FEATURES = (
    "close log_return_1 return_1 return_5 range body body_abs upper_wick lower_wick body_to_range "
    "volatility_10 volatility_20 sma_10 sma_20 sma_50 sma_100 sma_200 close_over_sma_10 close_over_sma_20 "
    "close_over_sma_50 close_over_sma_100 close_over_sma_200 ema_12 ema_26 close_over_ema_12 close_over_ema_26 "
    "macd macd_signal macd_hist bb_lower bb_mid bb_upper bb_width bb_pos volume volume_sma_20 volume_over_sma_20 "
    "rsi14 tenkan kijun senkoua senkoub"
).split()


def feature_matrix(bars: DataFrame, extras: tuple[str, ...] = (), *, block: int = BLOCK) -> DataFrame:
    """All named features in one halo pass, one recursive pass and the MACD signal pass.

    ``extras`` are further numeric columns, passed through as ``ext_<lower case name>``.
    """

    def windows(f: Frame) -> dict[str, Column]:
        out = {
            "return_1": pct_change(f, "close"),
            "return_5": pct_change(f, "close", 5),
            "log_return_1": log_return(f, "close"),
            "tenkan": mid_range(f, 9),
            "kijun": mid_range(f, 26),
            "_b": mid_range(f, 52),
            "bb_mid": f.full(F.avg, F.col("close"), 20),
            "_dev": f.full(F.stddev_pop, F.col("close"), 20),
            "volume_sma_20": f.full(F.avg, F.col("volume"), 20),
            "_d": F.col("close") - f.lag("close"),
        }
        out.update({f"sma_{p}": f.full(F.avg, F.col("close"), p) for p in SMA_PERIODS})
        return out

    def shifted(f: Frame) -> dict[str, Column]:
        d = F.col("_d")
        return {
            "volatility_10": f.full(F.stddev_pop, F.col("return_1"), 10),
            "volatility_20": f.full(F.stddev_pop, F.col("return_1"), 20),
            "senkoua": f.lag((F.col("tenkan") + F.col("kijun")) / 2.0, 26),
            "senkoub": f.lag("_b", 26),
            "_gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))),
            "_loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))),
        }

    x = over_blocks(bars, windows, shifted, back=201, block=block)
    x = ewm(
        x,
        {
            **{f"ema_{s}": ("close", ema_alpha(s), s) for s in EMA_SPANS},
            "_avg_gain": ("_gain", 1.0 / 14, 14),
            "_avg_loss": ("_loss", 1.0 / 14, 14),
        },
    )
    x = x.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    x = ewm(x, {"macd_signal": ("macd", ema_alpha(9), 9)})
    over = {f"close_over_{a}_{p}": ratio("close", f"{a}_{p}") - 1.0
            for a, ps in (("sma", SMA_PERIODS), ("ema", EMA_SPANS)) for p in ps}
    x = x.withColumns(
        {
            **candle_columns(),
            "rsi14": _rsi_value(),
            "macd_hist": F.col("macd") - F.col("macd_signal"),
            "bb_upper": F.col("bb_mid") + 2.0 * F.col("_dev"),
            "bb_lower": F.col("bb_mid") - 2.0 * F.col("_dev"),
            "bb_width": ratio(4.0 * F.col("_dev"), "bb_mid"),
            "bb_pos": ratio(F.col("close") - F.col("bb_mid") + 2.0 * F.col("_dev"), 4.0 * F.col("_dev")),
            "volume_over_sma_20": ratio("volume", "volume_sma_20") - 1.0,
            **over,
            **{f"ext_{e.strip().lower()}": F.col(f"`{e}`").try_cast("double") for e in extras},
        }
    )
    return x.select("symbol", "ts", "bar_no", *FEATURES, *[f"ext_{e.strip().lower()}" for e in extras])


def sequences(features: DataFrame, cols: list[str], lookback: int, label: str | None = None, *, block: int = BLOCK) -> DataFrame:
    """Array of the last ``lookback`` feature rows; incomplete, unlabelled or empty ones are left out."""
    row = F.array(*[F.col(c).cast("double") for c in cols])
    some = F.coalesce(*[F.col(c).cast("double") for c in cols]).isNotNull()

    def build(f: Frame) -> dict[str, Column]:
        return {
            "sequence": F.collect_list(row).over(f.last(lookback)),
            "_some": F.max(some).over(f.last(lookback)),
        }

    out = over_blocks(features, build, back=lookback, block=block)
    out = out.where((F.size("sequence") == lookback) & F.col("_some")).drop("_some")
    return out.where(F.col(label).isNotNull()) if label else out
