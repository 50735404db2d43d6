"""A rule-based strategy used by the flagship and the backtest queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators.layout import BLOCK, Frame, over_blocks


def crossover_signal(bars: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Follow the 20/50 mean crossover unless the close is at the far band."""

    def means(f: Frame) -> dict[str, Column]:
        c = F.col("close")
        return {"sma_20": f.full(F.avg, c, 20), "sma_50": f.full(F.avg, c, 50), "_dev": f.full(F.stddev_pop, c, 20)}

    out = over_blocks(bars, means, back=50, block=block)
    bb_pos = ratio(F.col("close") - F.col("sma_20") + 2.0 * F.col("_dev"), 4.0 * F.col("_dev"))
    s20, s50 = F.col("sma_20"), F.col("sma_50")
    signal = F.when((s20 > s50) & (F.col("bb_pos") < 0.8), 1.0).when((s20 < s50) & (F.col("bb_pos") > 0.2), -1.0).otherwise(0.0)
    return out.withColumn("bb_pos", bb_pos).withColumn("signal", signal).drop("_dev")


SQL_SIGNAL = """,
 sm AS (SELECT *,
   CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 19 PRECEDING) >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 19 PRECEDING) END AS sma_20,
   CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 49 PRECEDING) >= 50 THEN avg(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 49 PRECEDING) END AS sma_50,
   CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 19 PRECEDING) >= 20 THEN stddev_pop(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 19 PRECEDING) END AS dev
   FROM bars),
 sb AS (SELECT *, (close - sma_20 + 2*dev) / nullif(4*dev, 0) AS bb_pos FROM sm),
 sig AS (SELECT *, CASE WHEN sma_20 > sma_50 AND bb_pos < 0.8 THEN 1.0::DOUBLE WHEN sma_20 < sma_50 AND bb_pos > 0.2 THEN -1.0 ELSE 0.0 END AS signal FROM sb)"""
