"""Backtest run folders: summaries, trades, curves and per-asset metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.expr import number, parse_ts

METRICS = (
    "start string, end string, n_bars long, total_return double, cagr double, max_drawdown double, ann_factor double, "
    "sharpe double, avg_bar_return double, vol_bar double, turnover_sum double, n_position_changes long"
)
TRADE_METRICS = (
    "n_trades long, n_wins long, n_losses long, n_breakeven long, win_rate double, win_loss_ratio double, avg_win double, "
    "avg_loss double, profit_factor double, expectancy double, median_trade_return double, exit_reason_counts map<string,long>"
)


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{f.split()[0]}:{f.split()[1]}" for f in fields.replace("map<string,long>", "map<string;long>").split(", ")).replace(";", ",") + ">"


SUMMARY = (
    "asset string, input string, inputs array<string>, variant string, model string, core_model string, mode string, task string, "
    "signal_source string, price string, proba_enter double, stop_loss double, take_profit double, trailing_stop double, "
    "trailing_atr_mult double, atr_window int, stop_priority string, cost_bps double, slippage_bps double, execution_delay int, "
    "vol_target double, vol_lookback int, max_leverage double, portfolio_weighting string, weight_lookback int, "
    "uses_hmm string, uses_fft string, uses_wavelet string, uses_dmd string, uses_neural_net string, wavelet_kernel string, "
    f"wavelet_ar_p int, metrics {_struct(METRICS)}, trade_metrics {_struct(TRADE_METRICS)}, portfolio_metrics {_struct(METRICS)}"
)


def run_of(path: str | Column, up: int = 2) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(p, "/"), -up)


def parse_summaries(texts: DataFrame, *, value: str = "value") -> DataFrame:
    """(run, JSON text) to one typed row per run; NaN literals are read as such."""
    s = F.from_json(value, SUMMARY, {"allowNonNumericNumbers": "true"})
    return texts.select(*[c for c in texts.columns if c != value], s.alias("_s")).select("*", "_s.*").drop("_s")


def read_summaries(spark: SparkSession, root: str, pattern: str = "bt_*") -> DataFrame:
    texts = spark.read.text(f"{root}/{pattern}/backtest_summary.json", wholetext=True)
    return parse_summaries(texts.select(run_of("_metadata.file_path").alias("run"), "value"))


def read_trades(spark: SparkSession, root: str, pattern: str = "bt_*") -> DataFrame:
    """Trades of single-asset runs; header-less empty files give no rows."""
    schema = "entry_time string, exit_time string, side string, entry_price string, exit_price string, return string, exit_reason string"
    df = spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(f"{root}/{pattern}/trades.csv")
    return df.select(
        run_of("_metadata.file_path").alias("run"), parse_ts("entry_time").alias("entry_ts"), parse_ts("exit_time").alias("exit_ts"),
        "side", *[number(c).alias(c) for c in ("entry_price", "exit_price")], number("return").alias("ret"), "exit_reason",
    ).where(F.col("entry_ts").isNotNull())


def read_curves(spark: SparkSession, root: str, columns: list[str], pattern: str = "bt_*", name: str = "equity_curve.csv") -> DataFrame:
    """Equity curves of runs that share one column layout (the time column first)."""
    schema = ", ".join(["time string", *[f"`{c}` string" for c in columns]])
    df = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").csv(f"{root}/{pattern}/{name}")
    out = df.select(
        run_of("_metadata.file_path").alias("run"), parse_ts("time").alias("ts"),
        *[number(F.col(f"`{c}`")).alias(c) for c in columns if c not in ("event", "mark")],
    )
    return out.where(F.col("ts").isNotNull())


def read_asset_metrics(spark: SparkSession, root: str, pattern: str = "bt_*") -> DataFrame:
    """assets_metrics.csv of portfolio runs as long rows (run, asset, metric, value); the files'
    columns differ, so the header travels with each file's lines."""
    lines = spark.read.text(f"{root}/{pattern}/assets_metrics.csv").select(run_of("_metadata.file_path").alias("run"), "value")
    cells = F.split("value", ",")
    heads = lines.where(F.col("value").startswith("start,")).groupBy("run").agg(F.first(cells).alias("_h"))
    body = lines.where(~F.col("value").startswith("start,") & (F.trim("value") != "")).select("run", cells.alias("_c")).join(heads, "run")
    asset = F.get("_c", (F.array_position("_h", "asset") - 1).cast("int"))
    long = body.select("run", asset.alias("asset"), F.explode(F.arrays_zip(F.col("_h").alias("metric"), F.col("_c").alias("value"))).alias("_m"))
    return long.select("run", "asset", F.col("_m.metric").alias("metric"), number(F.col("_m.value")).alias("value")).where(
        ~F.col("metric").isin("asset", "start", "end") & F.col("value").isNotNull()
    )
