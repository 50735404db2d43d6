"""Exact medians and ranks without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import attach


def medians(df: DataFrame, key: Sequence[str], x: str, out: str = "median") -> DataFrame:
    """Exact median per key.

    A quantile sketch brackets the median, so that only the values between the two
    bounds are ranked; equal values are counted before that. The sketch decides how
    many values are ranked, never the result.
    """
    v = df.select(*key, F.col(x).alias("_x")).where(F.col("_x").isNotNull())
    spread, accuracy = 0.001, 10_000
    bounds = v.groupBy(*key).agg(
        F.percentile_approx("_x", [0.5 - spread, 0.5 + spread], accuracy).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
    )
    counted = (
        attach(v, bounds, key)
        .withColumn("_side", F.when(F.col("_x") < F.col("_b")[0], -1).when(F.col("_x") > F.col("_b")[1], 1).otherwise(0))
        .where(F.col("_side") <= 0)
        .groupBy(*key, "_n", F.when(F.col("_side") == 0, F.col("_x")).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    w = Window.partitionBy(*key).orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    holds = lambda r: (F.col("_lo") < r) & (F.col("_hi") >= r) & F.col("_x").isNotNull()
    return ranked.groupBy(*key).agg(
        ((F.max(F.when(holds(lower), F.col("_x"))) + F.max(F.when(holds(upper), F.col("_x")))) / 2.0).alias(out)
    )


def average_ranks(df: DataFrame, key: Sequence[str], x: str, out: str = "rank", *, slices: int = 64) -> DataFrame:
    """Average rank of x within its key (1-based, ties share their mean rank).

    Values are counted, cut into slices at sketched quantiles, and ranked slice by slice
    on top of the sizes of the slices below. The cuts only balance the work.
    """
    counted = df.where(F.col(x).isNotNull()).groupBy(*key, x).agg(F.count(F.lit(1)).alias("_c"))
    cuts = counted.groupBy(*key).agg(
        F.percentile_approx(x, [i / slices for i in range(1, slices)], 1000).alias("_cuts")
    )
    sliced = attach(counted, cuts, key).withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col(x)))
    ).drop("_cuts")
    sizes = sliced.groupBy(*key, "_slice").agg(F.sum("_c").alias("_s"))
    below = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, "_slice", F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*key, "_slice").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(starts, [*key, "_slice"]).withColumn("_upto", F.col("_start") + F.sum("_c").over(inside))
    ranked = ranked.select(*key, x, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out))
    return df.join(ranked, [*key, x], "left")
