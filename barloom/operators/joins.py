"""Aligning series with each other: exact, as-of, pivoted and panel joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import MICROS_PER_DAY, micros
from barloom.operators.layout import BLOCK, carried, number_rows, over_blocks
from barloom.session import durable


def pivot_series(macro: DataFrame, series: Sequence[str] | None = None) -> DataFrame:
    """Long (series_id, date, value) to one column per series; every date of any series is kept."""
    by_date = macro.groupBy("date")
    wide = by_date.pivot("series_id", list(series)) if series else by_date.pivot("series_id")
    return wide.agg(F.first("value", ignorenulls=True))


def first_series_wins(macro: DataFrame, priority: str = "priority") -> DataFrame:
    """One value per series and date, from the source with the lowest priority number."""
    return macro.groupBy("series_id", "date").agg(F.min_by("value", priority).alias("value"))


def exact_then_fill(bars: DataFrame, extra: DataFrame, cols: Sequence[str], *, on: str = "date", block: int = BLOCK) -> DataFrame:
    """Left join on the bar's date, then carry the last value forward. An observation dated
    on a day without a bar never appears; see ``asof_join`` for the join that keeps it."""
    e = extra.select(F.col(on).cast("timestamp_ntz").alias("ts"), *[F.col(f"`{c}`") for c in cols])
    out = bars.join(e, "ts", "left")
    return carried(
        out.withColumnsRenamed({c: f"_v{i}" for i, c in enumerate(cols)}),
        {c: ("last", F.col(f"_v{i}")) for i, c in enumerate(cols)},
        block=block,
    ).drop(*[f"_v{i}" for i in range(len(cols))])


def asof_join(bars: DataFrame, extra: DataFrame, cols: Sequence[str], *, on: str = "date", block: int = BLOCK) -> DataFrame:
    """Latest known value per column with date <= ts.

    The observations become validity intervals, cut at day borders, and the join is an
    equi-join on the day plus a range check. Neither side is replicated per symbol.
    """
    names = {c: f"_v{i}" for i, c in enumerate(cols)}
    obs = extra.select(F.col(on).cast("timestamp_ntz").alias("_from"), *[F.col(f"`{c}`").alias(v) for c, v in names.items()])
    obs = number_rows(obs, key=(), order="_from", step_seconds=86_400, name="_o")
    obs = carried(obs, {f"{v}_f": ("last", F.col(v)) for v in names.values()}, key=(), pos="_o", block=block)
    obs = over_blocks(obs, lambda f: {"_to": f.lead("_from")}, back=0, ahead=1, key=(), pos="_o", block=block)
    day = lambda c: F.floor(micros(c) / MICROS_PER_DAY)
    end = bars.agg(F.max("ts").alias("_last"))
    obs = obs.join(F.broadcast(end)).where(F.col("_from") <= F.col("_last"))
    last_day = F.greatest(day("_from"), F.coalesce(F.floor((micros("_to") - 1) / MICROS_PER_DAY), day("_last")))
    obs = obs.withColumn("_day", F.explode(F.sequence(day("_from"), F.least(last_day, F.greatest(day("_last"), day("_from"))))))
    obs = obs.select("_day", "_from", "_to", *[F.col(f"{v}_f").alias(c) for c, v in names.items()])
    b = bars.withColumn("_day", day("ts"))
    hit = (b["_day"] == obs["_day"]) & (b["ts"] >= obs["_from"]) & (obs["_to"].isNull() | (b["ts"] < obs["_to"]))
    return b.join(obs, hit, "left").drop("_day", "_from", "_to")


def calendar(rows: DataFrame, *, step_seconds: int = 86_400) -> DataFrame:
    """Numbered distinct timestamps (ts, t_no)."""
    return number_rows(rows.select("ts").distinct(), key=(), step_seconds=step_seconds, name="t_no")


def panel_inner(bars: DataFrame, *, value: str = "close") -> DataFrame:
    """Rows at timestamps where every symbol has a value."""
    v = bars.where(F.col(value).isNotNull())
    n = v.agg(F.count_distinct("symbol").alias("_n"))
    full = v.groupBy("ts").agg(F.count(F.lit(1)).alias("_c")).join(F.broadcast(n)).where("_c = _n").select("ts")
    return v.join(full, "ts", "left_semi").select("symbol", "ts", value)


def panel_outer(bars: DataFrame, *, value: str = "close", step_seconds: int = 86_400, block: int = BLOCK) -> DataFrame:
    """Every timestamp of any symbol, gaps filled forward, from where all symbols have started.

    Each row is repeated up to the symbol's next row, so only real gaps add rows and the
    timestamp x symbol grid is never joined together.
    """
    v = bars.where(F.col(value).isNotNull()).select("symbol", "ts", "bar_no", value)
    v = durable(number_rows(durable(v.drop("bar_no")), step_seconds=step_seconds))
    cal = durable(calendar(v, step_seconds=step_seconds))
    v = v.join(cal, "ts")
    v = over_blocks(v, lambda f: {"_next": f.lead("t_no")}, back=0, ahead=1, block=block)
    size = cal.agg(F.max("t_no").alias("_t"))
    begin = v.where("bar_no = 0").agg(F.max("t_no").alias("_begin"))
    v = v.join(F.broadcast(size)).join(F.broadcast(begin))
    stop = F.coalesce(F.col("_next") - 1, F.col("_t"))
    filled = v.where(stop >= F.col("_begin")).select(
        "symbol", value, F.explode(F.sequence(F.greatest("t_no", "_begin"), stop)).alias("t_no")
    )
    return filled.join(cal, "t_no").select("symbol", "ts", value)


def common_symbols(panels: Sequence[DataFrame]) -> DataFrame:
    """Symbols present in every panel."""
    out = panels[0].select("symbol").distinct()
    for p in panels[1:]:
        out = out.intersect(p.select("symbol").distinct())
    return out


def joint_dates(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    x, y = a.select("ts"), b.select("ts")
    return x.intersect(y) if how == "inner" else x.union(y).distinct()


def stack_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """Union of feeds whose columns differ."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_sources(tickers: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Each ticker once per configured source."""
    return tickers.select("ticker", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))


def align_columns(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """The expected model columns in order; absent ones are 0.0, others are dropped."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) if c in have else F.lit(0.0).alias(c) for c in expected])
