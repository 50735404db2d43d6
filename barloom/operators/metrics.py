"""Curve, trade, classification and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import MICROS_PER_DAY, finite, micros, ratio
from barloom.operators.layout import BLOCK, carried, over_blocks
from barloom.operators.order_stats import medians

DAYS_PER_YEAR = 365.25


def annualisation(n: Column, first: Column, last: Column) -> Column:
    """Bars per year by the span of the series; NULL for fewer than three bars or no span."""
    years = (micros(last) - micros(first)) / float(MICROS_PER_DAY) / DAYS_PER_YEAR
    return F.when((n >= 3) & (years > 0), n / F.nullif(years, F.lit(0.0)))


def drawdowns(curve: DataFrame, *, key: Sequence[str] = ("symbol",), block: int = BLOCK) -> DataFrame:
    out = carried(curve, {"_peak": ("max", F.col("equity"))}, key=key, block=block)
    return out.withColumn("drawdown", F.col("equity") / F.nullif(F.col("_peak"), F.lit(0.0)) - 1.0).drop("_peak")


def curve_metrics(curve: DataFrame, *, key: Sequence[str] = ("symbol",), block: int = BLOCK) -> DataFrame:
    """One row per curve. The curve is numbered (bar_no) and has equity and strategy_ret;
    position and turnover are used if present."""
    traded = {"position", "turnover"} <= set(curve.columns)
    dd = drawdowns(curve, key=key, block=block)
    if traded:
        dd = over_blocks(
            dd,
            lambda f: {"_moved": (F.coalesce("position", F.lit(0.0)) != F.coalesce(f.lag("position"), F.lit(0.0)))
                       & f.lag("bar_no").isNotNull()},
            back=1, key=key, block=block,
        )
    aggs = [
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("equity").alias("n_bars"),
        F.min_by("equity", "bar_no").alias("_e0"), F.max_by("equity", "bar_no").alias("_e1"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg("strategy_ret").alias("avg_bar_return"), F.stddev_pop("strategy_ret").alias("vol_bar"),
    ]
    if traded:
        aggs += [F.sum(F.coalesce("turnover", F.lit(0.0))).alias("turnover_sum"), F.count_if("_moved").alias("n_position_changes")]
    m = dd.groupBy(*key).agg(*aggs)
    days = F.floor((micros("end") - micros("start")) / MICROS_PER_DAY)
    growth = ratio("_e1", "_e0")
    m = m.withColumns(
        {
            "total_return": growth - 1.0,
            "cagr": F.when(days > 0, F.pow(growth, DAYS_PER_YEAR / F.nullif(days, F.lit(0))) - 1.0),
            "ann_factor": annualisation(F.col("n_bars"), F.col("start"), F.col("end")),
        }
    )
    m = m.withColumn("sharpe", F.when(F.col("vol_bar") > 0, ratio("avg_bar_return", "vol_bar") * F.sqrt("ann_factor")))
    names = "start end n_bars total_return cagr max_drawdown ann_factor sharpe avg_bar_return vol_bar".split()
    return m.select(*key, *names, *(["turnover_sum", "n_position_changes"] if traded else []))


def trade_metrics(trades: DataFrame, *, key: Sequence[str] = ("symbol",), ret: str = "ret") -> DataFrame:
    """Counts, win rate, count ratio, averages, profit factor, expectancy and median return.
    Ratios without losses are infinite when there are wins, else NULL."""
    t = trades.withColumn("_r", finite(F.col(ret).cast("double"))).where(F.col("_r").isNotNull())
    win, loss = F.col("_r") > 0, F.col("_r") < 0
    m = t.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(win).alias("n_wins"), F.count_if(loss).alias("n_losses"),
        F.count_if(F.col("_r") == 0).alias("n_breakeven"),
        F.avg(F.when(win, F.col("_r"))).alias("avg_win"), F.avg(F.when(loss, F.col("_r"))).alias("avg_loss"),
        F.coalesce(F.sum(F.when(win, F.col("_r"))), F.lit(0.0)).alias("_up"),
        F.coalesce(F.sum(F.when(loss, -F.col("_r"))), F.lit(0.0)).alias("_down"),
        F.avg("_r").alias("expectancy"),
    )

    def against(a: str, b: str) -> Column:
        return F.coalesce(ratio(F.col(a).cast("double"), F.col(b).cast("double")), F.when(F.col(a) > 0, F.lit(float("inf"))))

    m = m.withColumns(
        {
            "win_rate": F.col("n_wins") / F.col("n_trades"),
            "win_loss_ratio": against("n_wins", "n_losses"),
            "profit_factor": against("_up", "_down"),
        }
    )
    med = medians(t, key, "_r", "median_trade_return")
    return m.join(med, [*key], "left").select(
        *key, "n_trades", "n_wins", "n_losses", "n_breakeven", "win_rate", "win_loss_ratio", "avg_win", "avg_loss",
        "profit_factor", "expectancy", "median_trade_return",
    )


def exit_reasons(trades: DataFrame, *, key: Sequence[str] = ("symbol",)) -> DataFrame:
    return trades.groupBy(*key, "exit_reason").agg(F.count(F.lit(1)).alias("n"))


def portfolio_trade_rollup(per_asset: DataFrame, key: str = "run") -> DataFrame:
    """Trades summed, win rate and profit factor averaged over assets that traded."""
    some = F.col("n_trades") > 0
    return per_asset.groupBy(key).agg(
        F.sum("n_trades").alias("n_trades"),
        F.avg(F.when(some, finite("win_rate"))).alias("win_rate"),
        F.avg(F.when(some, finite("profit_factor"))).alias("profit_factor"),
    )


CLASSES = (-1, 0, 1)


def confusion(pred: DataFrame, y: str = "label", p: str = "prediction", *, key: Sequence[str] = ()) -> DataFrame:
    """All nine cells per key, zero where a pair does not occur."""
    pairs = [(a, b) for a in CLASSES for b in CLASSES]
    hit = lambda a, b: (F.col(y).cast("int") == a) & (F.col(p).cast("int") == b)
    counts = pred.groupBy(*key).agg(*[F.count_if(hit(a, b)).alias(f"_n{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"_n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    return counts.select(*key, F.inline(F.array(*cells)))


def class_report(cells: DataFrame, *, key: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion cells (0 where undefined)."""
    sides = cells.select(
        *key, "n",
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("class"), F.lit("a").alias("side"), (F.col("actual") == F.col("predicted")).alias("hit")),
                F.struct(F.col("predicted").alias("class"), F.lit("p").alias("side"), F.lit(False).alias("hit")),
            )
        ),
    )
    r = sides.groupBy(*key, "class").agg(
        F.sum(F.when((F.col("side") == "a") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("called"),
    )
    r = r.withColumns(
        {
            "precision": F.coalesce(ratio(F.col("tp").cast("double"), F.col("called").cast("double")), F.lit(0.0)),
            "recall": F.coalesce(ratio(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0)),
        }
    )
    both = F.col("precision") + F.col("recall")
    f1 = F.coalesce(ratio(2.0 * F.col("precision") * F.col("recall"), both), F.lit(0.0))
    return r.withColumn("f1", f1).select(*key, "class", "precision", "recall", "f1", "support", "called", "tp")


def classification_metrics(pred: DataFrame, y: str = "label", p: str = "prediction", *, key: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1. Macro F1 ranges over classes that occur in
    labels or predictions, balanced accuracy over classes that occur in labels."""
    report = class_report(confusion(pred, y, p, key=key), key=key)
    return report.groupBy(*key).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.nullif(F.sum("support"), F.lit(0))).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when((F.col("support") > 0) | (F.col("called") > 0), F.col("f1"))).alias("f1_macro"),
    )


def regression_metrics(pred: DataFrame, y: str = "label", p: str = "prediction", *, key: Sequence[str] = ()) -> DataFrame:
    e = F.col(y) - F.col(p)
    m = pred.groupBy(*key) if key else pred.groupBy()
    return m.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1.0 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
    )


def top_mean(scores: DataFrame, by: str = "ts", score: str = "score", k: int = 5, out: str = "index") -> DataFrame:
    """Mean of the k best scores per group. One partial pass keeps k per slice of a group."""
    slices = scores.withColumn("_s", F.pmod(F.xxhash64(*[c for c in scores.columns]), F.lit(32)))
    first = Window.partitionBy(by, "_s").orderBy(F.desc(score))
    kept = slices.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    best = Window.partitionBy(by).orderBy(F.desc(score))
    kept = kept.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    return kept.groupBy(by).agg(F.avg(score).alias(out))
