"""Volatility regimes: mixture states and the risk-off gate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import attach, durable


def mixture_states(rows: DataFrame, *, value: str = "ret", train: Column, k: int = 3, steps: int = 15) -> DataFrame:
    """Assign each row the likeliest of k Gaussian states fitted to its symbol's training rows.

    All symbols are fitted together: one aggregate per step sums the responsibilities, and
    only k means, deviations and weights per symbol are carried to the next step.
    """
    x = durable(rows.withColumn("_x", F.coalesce(F.col(value), F.lit(0.0))).withColumn("_train", train))
    qs = [(i + 0.5) / k for i in range(k)]
    start = x.where("_train").groupBy("symbol").agg(
        F.percentile_approx("_x", qs, 1000).alias("mu"), F.greatest(F.stddev_pop("_x"), F.lit(1e-9)).alias("_s")
    )
    ids = F.sequence(F.lit(0), F.lit(k - 1))
    params = start.select(
        "symbol", "mu", F.array_repeat("_s", k).alias("sd"), F.array_repeat(F.lit(1.0 / k), k).alias("w"), F.col("_s").alias("s0")
    )

    def densities() -> Column:
        at = lambda c, i: F.get(F.col(c), i)
        return F.transform(
            ids,
            lambda i: F.ln(at("w", i)) - F.ln(at("sd", i)) - F.pow((F.col("_x") - at("mu", i)) / at("sd", i), 2) / 2.0
            - 0.5 * math.log(2 * math.pi),
        )

    for step in range(steps):
        d = attach(x.where("_train"), params).withColumn("_d", densities())
        e = F.transform("_d", lambda v: F.exp(v - F.array_max("_d")))
        d = d.withColumn("_e", e)
        total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
        sums = []
        for i in range(k):
            r = F.get("_e", F.lit(i)) / total
            sums += [F.sum(r).alias(f"_n{i}"), F.sum(r * F.col("_x")).alias(f"_m{i}"), F.sum(r * F.col("_x") * F.col("_x")).alias(f"_q{i}")]
        g = d.groupBy("symbol", "s0").agg(*sums, F.count(F.lit(1)).alias("_n"))
        n = [F.greatest(F.col(f"_n{i}"), F.lit(1e-9)) for i in range(k)]
        mu = [F.col(f"_m{i}") / n[i] for i in range(k)]
        var = [F.greatest(F.col(f"_q{i}") / n[i] - mu[i] * mu[i], F.pow(F.col("s0") * 1e-3, 2)) for i in range(k)]
        params = g.select(
            "symbol", F.array(*mu).alias("mu"), F.array(*[F.sqrt(v) for v in var]).alias("sd"),
            F.array(*[c / F.col("_n") for c in n]).alias("w"), "s0",
        )
    out = attach(x, params).withColumn("_d", densities())
    state = (F.array_position("_d", F.array_max("_d")) - 1).cast("int")
    return out.withColumn("state", state).drop("_x", "_train", "_d", "mu", "sd", "w", "s0")


def risk_off(rows: DataFrame, *, value: str = "ret", state: str = "state", train: Column, min_count: int = 10) -> DataFrame:
    """Adds risk_off: the row is in the state with the highest training deviation (ties: lower mean)."""
    r = F.coalesce(F.col(value), F.lit(0.0))
    stats = rows.where(train & F.col(state).isNotNull()).groupBy("symbol", F.col(state).alias("_state")).agg(
        F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") >= min_count)
    w = Window.partitionBy("symbol").orderBy(F.desc("_std"), F.asc("_mean"))
    worst = stats.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("symbol", "_state")
    out = attach(rows, worst, how="left")
    return out.withColumn("risk_off", F.coalesce(F.col(state) == F.col("_state"), F.lit(False))).drop("_state")
