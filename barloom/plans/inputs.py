"""Bar tables derived from the given tables, with the SQL text of the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import build_bars

HOUR, DAY, WEEK = 3600, 86_400, 604_800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share out a table that was read in fewer pieces than there are cores (one small file is one
    piece, whatever runs on it). Tables with enough pieces stay where they are. Hashing a key,
    unlike dealing rows out in turn, gives the same pieces when a task is repeated."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def line_order() -> Column:
    """The given lines repeat some (order, line) pairs; the price settles those."""
    return F.struct("l_orderkey", "l_linenumber", "l_extendedprice")


def event_bars(spark: SparkSession, sf_dir: str, *, numbered: bool = True) -> DataFrame:
    """Hourly bars per event type; the value plus 1000 is the price."""
    e = table(spark, sf_dir, "events")
    return build_bars(
        e, symbol="event_type", ts="ts", price=F.col("value") + 1000.0, order_key=F.struct("ts", "event_id"),
        unit="hour", step_seconds=HOUR, numbered=numbered,
    )


def ship_bars(spark: SparkSession, sf_dir: str, *, numbered: bool = True) -> DataFrame:
    """Daily bars per return flag and line status; the line value plus a million is the price,
    which keeps returns to a few percent."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return build_bars(
        li, symbol=F.concat("l_returnflag", "l_linestatus"), ts="l_shipdate",
        price=F.col("l_extendedprice") + 1_000_000.0,
        order_key=line_order(),
        unit="day", volume=F.col("l_quantity"), step_seconds=DAY, numbered=numbered,
    )


def brand_bars(spark: SparkSession, sf_dir: str, *, numbered: bool = True) -> DataFrame:
    """Weekly line-value bars per part brand."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").join(
        table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    return build_bars(
        li, symbol="p_brand", ts="l_shipdate",
        price=F.col("l_extendedprice") + 1_000_000.0,
        order_key=line_order(),
        unit="week", volume=F.col("l_quantity"), step_seconds=WEEK, numbered=numbered,
    )


def order_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean order value per priority, as a macro series dated on month start."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("date")
    ).agg(F.avg("o_totalprice").alias("value"))


SQL_EVENT_BARS = """
bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM (
    SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts,
           arg_min(value + 1000.0, (ts, event_id)) AS open, max(value + 1000.0) AS high,
           min(value + 1000.0) AS low, arg_max(value + 1000.0, (ts, event_id)) AS close,
           count(*)::DOUBLE AS volume
    FROM events GROUP BY 1, 2))"""

SQL_SHIP_BARS = """
bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM (
    SELECT l_returnflag || l_linestatus AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
           arg_min(l_extendedprice + 1000000.0, (l_orderkey, l_linenumber, l_extendedprice)) AS open,
           max(l_extendedprice + 1000000.0) AS high, min(l_extendedprice + 1000000.0) AS low,
           arg_max(l_extendedprice + 1000000.0, (l_orderkey, l_linenumber, l_extendedprice)) AS close,
           sum(l_quantity)::DOUBLE AS volume
    FROM lineitem GROUP BY 1, 2))"""

SQL_BRAND_BARS = """
bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM (
    SELECT p_brand AS symbol, date_trunc('week', l_shipdate)::TIMESTAMP AS ts,
           arg_min(l_extendedprice + 1000000.0, (l_orderkey, l_linenumber, l_extendedprice)) AS open,
           max(l_extendedprice + 1000000.0) AS high, min(l_extendedprice + 1000000.0) AS low,
           arg_max(l_extendedprice + 1000000.0, (l_orderkey, l_linenumber, l_extendedprice)) AS close,
           sum(l_quantity)::DOUBLE AS volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""

SQL_ORDER_MACRO = """
macro AS (
  SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS date,
         avg(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines' summation orders give the same text."""
    return df.select(
        *[F.round(f"`{n}`", digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def sql_select(names: str, *, plain: str = "symbol ts", digits: int = 6) -> str:
    """Select list: plain columns as they are, the others rounded under their own name."""
    return ", ".join([*plain.split(), *[f"round({n}, {digits}) AS {n}" for n in names.split()]])
