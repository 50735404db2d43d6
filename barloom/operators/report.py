"""Comparison of backtest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import finite, is_truthy
from barloom.functions.symbols import is_crypto
from barloom.operators.backtest import LONG_ONLY
from barloom.operators.joins import stack_feeds
from barloom.operators.metrics import curve_metrics, portfolio_trade_rollup

# fixed values: short model names
MODEL_NAMES = {
    "histgradientboosting": "hgb", "histgradientboostingclassifier": "hgb", "randomforest": "rf", "randomforestclassifier": "rf",
    "mlpclassifier": "mlp", "neural_net": "mlp", "neural": "mlp", "nn": "mlp",
}
CONFIG = (
    "asset mode task signal_source price stop_loss take_profit trailing_stop trailing_atr_mult atr_window stop_priority cost_bps "
    "slippage_bps execution_delay vol_target vol_lookback max_leverage portfolio_weighting weight_lookback model input "
    "wavelet_kernel wavelet_ar_p"
).split()
FLAGS = (
    "long_only uses_proba_signal uses_stop_loss uses_take_profit uses_trailing_stop uses_trailing_atr uses_vol_target uses_hmm "
    "uses_fft uses_wavelet uses_dmd uses_neural_net"
).split()
CURVE = "start end n_bars total_return cagr max_drawdown ann_factor sharpe avg_bar_return vol_bar turnover_sum n_position_changes".split()
TRADES = "n_trades n_wins n_losses n_breakeven win_rate win_loss_ratio avg_win avg_loss profit_factor expectancy median_trade_return".split()


def component_flags(runs: DataFrame) -> DataFrame:
    """Twelve boolean flags from a run's configuration."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    above = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return runs.withColumns(
        {
            "long_only": low("mode").isin(*LONG_ONLY),
            "uses_proba_signal": low("signal_source").isin("proba", "prob", "predict_proba"),
            "uses_stop_loss": above("stop_loss"),
            "uses_take_profit": above("take_profit"),
            "uses_trailing_stop": above("trailing_stop"),
            "uses_trailing_atr": above("trailing_atr_mult"),
            "uses_vol_target": above("vol_target"),
            **{f"uses_{n}": is_truthy(f"uses_{n}") for n in ("hmm", "fft", "wavelet", "dmd")},
            "uses_neural_net": is_truthy("uses_neural_net") | low("model").isin("mlp", "nn", "neural", "neural_net"),
        }
    )


def wavelet_label() -> Column:
    k = F.lower(F.trim("wavelet_kernel"))
    name = (
        F.when(k.isNull(), "wavelet")
        .when(k.startswith("dwt_db"), F.concat(F.lit("wv_"), F.replace(k, F.lit("dwt_"), F.lit(""))))
        .when(k.contains("morlet"), "wv_morlet")
        .when(k.contains("ricker") | k.contains("mexh"), "wv_ricker")
        .otherwise(F.concat(F.lit("wv_"), F.regexp_replace(F.regexp_replace(k, "[^a-z0-9]+", "_"), "^_+|_+$", "")))
    )
    return F.when(F.col("wavelet_ar_p").isNotNull(), F.concat(name, F.lit("_ar"), F.col("wavelet_ar_p").cast("string"))).otherwise(name)


def combo_label(flags: DataFrame, model: str = "model") -> DataFrame:
    """Adds feature_combo such as hgb+hmm+wv_db8_ar5+vol_target."""
    m = F.lower(F.trim(F.coalesce(model, "core_model") if "core_model" in flags.columns else F.col(model)))
    table = F.create_map(*[F.lit(x) for kv in MODEL_NAMES.items() for x in kv])
    short = F.when(m != "", F.coalesce(table[m], m))
    named = [
        ("long_only", "long_only"), ("uses_proba_signal", "proba"), ("uses_hmm", "hmm"), ("uses_fft", "fft"),
        ("uses_wavelet", wavelet_label()), ("uses_dmd", "dmd"), ("uses_neural_net", "nn"), ("uses_stop_loss", "stop"),
        ("uses_take_profit", "tp"), ("uses_trailing_stop", "trail"), ("uses_trailing_atr", "trail_atr"),
        ("uses_vol_target", "vol_target"),
    ]
    parts = [F.when(F.col(f), F.lit(n) if isinstance(n, str) else n) for f, n in named]
    text = F.concat_ws("+", short, *parts)
    return flags.withColumn("feature_combo", F.when(text == "", "baseline").otherwise(text))


def report_rows(
    runs: DataFrame, asset_trades: DataFrame | None = None, curves: DataFrame | None = None, run_trades: DataFrame | None = None
) -> DataFrame:
    """One row per run: configuration, flags, combo, m_* metrics (portfolio first) and t_* trade
    metrics. ``run_trades`` (run, metrics) and ``asset_trades`` (run, n_trades, win_rate,
    profit_factor) fill trade metrics a summary lacks; ``curves`` (run, ts, bar_no, equity,
    strategy_ret) replaces the stored curve metrics."""
    r = runs.withColumn("is_portfolio", F.col("portfolio_metrics").isNotNull())
    m = F.when(F.col("is_portfolio"), F.col("portfolio_metrics")).otherwise(F.col("metrics"))
    r = r.withColumn("_m", m).withColumns({f"m_{c}": F.col("_m")[c] for c in CURVE})
    r = r.withColumns({f"t_{c}": F.col("trade_metrics")[c] for c in TRADES})
    if curves is not None:
        fresh = curve_metrics(curves, key=("run",))
        have = [c for c in CURVE if c in fresh.columns]
        fresh = fresh.select("run", *[F.col(c).cast("string" if c in ("start", "end") else fresh.schema[c].dataType).alias(f"_{c}") for c in have])
        r = r.join(fresh, "run", "left")
        r = r.withColumns({f"m_{c}": F.coalesce(f"_{c}", f"m_{c}") for c in have}).drop(*[f"_{c}" for c in have])
    for extra in (run_trades, portfolio_trade_rollup(asset_trades, "run") if asset_trades is not None else None):
        if extra is not None:
            cols = [c for c in TRADES if c in extra.columns]
            r = r.join(extra.select("run", *[F.col(c).alias(f"_{c}") for c in cols]), "run", "left")
            absent = F.col("trade_metrics").isNull()
            r = r.withColumns({f"t_{c}": F.when(absent, F.coalesce(f"t_{c}", f"_{c}")).otherwise(F.col(f"t_{c}")) for c in cols})
            r = r.drop(*[f"_{c}" for c in cols])
    r = combo_label(component_flags(r))
    return r.select("run", "is_portfolio", *CONFIG, *FLAGS, "feature_combo", *[f"m_{c}" for c in CURVE], *[f"t_{c}" for c in TRADES])


def exclude_crypto(runs: DataFrame, run_assets: DataFrame) -> DataFrame:
    """Drop single-asset crypto runs and portfolios made of crypto only; keep unknown ones."""
    per = run_assets.groupBy("run").agg(F.bool_and(is_crypto("asset")).alias("_all"))
    r = runs.join(per, "run", "left")
    drop = F.when(F.col("is_portfolio"), F.coalesce("_all", F.lit(False))).otherwise(is_crypto("asset"))
    return r.where(~drop).drop("_all")


def asset_rows(report: DataFrame, portfolio_assets: DataFrame) -> DataFrame:
    """Per-asset rows of all runs: single runs by their own metrics, portfolios by their assets'."""
    single = report.where(~F.col("is_portfolio")).select(
        "run", F.coalesce("asset", "run").alias("asset"), *[c for c in report.columns if c.startswith("m_")]
    )
    return stack_feeds([single, portfolio_assets])


def merge_asset(report: DataFrame, assets: DataFrame, asset: str, order: str = "pos") -> DataFrame:
    """Run configuration with one asset's metrics, the latest row per run."""
    metrics = [c for c in assets.columns if c.startswith("m_")]
    one = assets.where(F.col("asset") == asset).groupBy("run").agg(F.max_by(F.struct("asset", *metrics), order).alias("_a"))
    keep = [c for c in report.columns if not c.startswith("m_") and c != "asset"]
    return report.select(*keep).join(one, "run").select(*keep, "_a.*")


def ranked_runs(report: DataFrame, score: str = "m_sharpe", *, drop_flat: bool = False) -> DataFrame:
    """Best first; optionally without missing, infinite or zero scores."""
    out = report.withColumn(score, F.col(score).cast("double"))
    if drop_flat:
        out = out.where(finite(score).isNotNull() & (F.abs(score) > 1e-12))
    return out.orderBy(F.desc_nulls_last(score), "run")


def best_per_asset(assets: DataFrame, score: str = "m_sharpe") -> DataFrame:
    """Best run of each asset (ties: the first name)."""
    s = finite(F.col(score).cast("double"))
    top = assets.where(s.isNotNull()).groupBy("asset").agg(F.min(F.struct((-s).alias("s"), F.col("run").alias("run"))).alias("_b"))
    return top.select("asset", F.col("_b.run").alias("run"), (-F.col("_b.s")).alias(score)).orderBy(F.desc(score))


def component_matrix(report: DataFrame) -> DataFrame:
    return report.select("run", *[F.col(f).cast("double").alias(f) for f in FLAGS])


def risk_return(report: DataFrame) -> DataFrame:
    return report.select("run", "m_max_drawdown", "m_total_return")
