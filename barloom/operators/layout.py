"""How an ordered series is spread over tasks.

A plain ``Window.partitionBy('symbol')`` puts a whole symbol into one task, so a
symbol that holds a third of the rows decides the run time of the job. Everything
here cuts a series into blocks of consecutive rows instead:

* ``number_rows`` gives each row its position, with one window per time bucket;
* ``over_blocks`` evaluates bounded frames on ``(symbol, block)`` after copying the
  few rows a frame can reach across a block edge;
* ``carried`` evaluates running totals: local to a block, plus what the blocks
  before it add up to.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.expr import seconds
from barloom.session import durable

KEY = ("symbol",)
ROWS_PER_BUCKET = 4096
BLOCK = 4096


def number_rows(
    df: DataFrame,
    *,
    key: Sequence[str] = KEY,
    order: str = "ts",
    ties: Sequence[str] = (),
    step_seconds: int = 3600,
    name: str = "bar_no",
) -> DataFrame:
    """Add the 0-based position of a row in its series.

    ``step_seconds`` is the usual distance of two rows; it sets the width of the
    time buckets that are sorted independently. Only one row per bucket goes
    through the per-series window that adds up the bucket sizes. A row without a time or a key
    has no place in a series and is left out.
    """
    df = df.dropna(subset=[*key, order])
    width = step_seconds * ROWS_PER_BUCKET
    bucketed = df.withColumn("_bucket", F.floor(seconds(order) / F.lit(width)))
    sizes = bucketed.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy("_bucket")
    starts = sizes.select(
        *key,
        "_bucket",
        F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*key, "_bucket").orderBy(order, *ties)
    return (
        bucketed.join(starts, [*key, "_bucket"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )


class Frame:
    """Windows of one block, handed to the functions that build columns."""

    def __init__(self, spec: WindowSpec):
        self.spec = spec

    def last(self, n: int) -> WindowSpec:
        return self.spec.rowsBetween(-(n - 1), 0)

    def around(self, k: int) -> WindowSpec:
        return self.spec.rowsBetween(-k, k)

    def full(self, agg: Callable[[Column], Column], x: Column, n: int, min_periods: int | None = None) -> Column:
        """Aggregate over the last n rows, NULL until enough of them are present."""
        need = n if min_periods is None else min_periods
        return F.when(F.count(x).over(self.last(n)) >= need, agg(x).over(self.last(n)))

    def lag(self, x: str | Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.spec)

    def lead(self, x: str | Column, k: int = 1) -> Column:
        return F.lead(x, k).over(self.spec)


def with_halo(
    df: DataFrame, back: int, ahead: int = 0, *, pos: str = "bar_no", block: int = BLOCK
) -> DataFrame:
    """Add ``_blk`` and ``_own``; rows near an edge also go to the neighbour block."""
    size = max(block, back, ahead, 1)
    blk = F.floor(F.col(pos) / F.lit(size))
    off = F.col(pos) - blk * size

    def copy(b: Column, own: bool) -> Column:
        return F.struct(b.alias("_blk"), F.lit(own).alias("_own"))

    copies = [copy(blk, True)]
    if back > 0:
        copies.append(F.when(off >= size - back, copy(blk + 1, False)))
    if ahead > 0:
        copies.append(F.when((off < ahead) & (blk > 0), copy(blk - 1, False)))
    return df.select("*", F.inline(F.array_compact(F.array(*copies))))


def over_blocks(
    df: DataFrame,
    *steps: Callable[[Frame], dict[str, Column]],
    back: int,
    ahead: int = 0,
    key: Sequence[str] = KEY,
    pos: str = "bar_no",
    block: int = BLOCK,
) -> DataFrame:
    """Add columns built from bounded frames. Later steps may use earlier columns;
    ``back`` and ``ahead`` are the reach of all steps together."""
    out = with_halo(df, back, ahead, pos=pos, block=block)
    frame = Frame(Window.partitionBy(*key, "_blk").orderBy(pos))
    for step in steps:
        out = out.withColumns(step(frame))
    return out.where("_own").drop("_blk", "_own")


_LOCAL = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "product": F.product,
    "count": F.count,
}


def _join_parts(kind: str, before: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull() & local.isNull(), None).otherwise(
            F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
        )
    if kind == "count":
        return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "product":
        return F.coalesce(before * local, before, local)
    if kind == "max":
        return F.greatest(before, local)
    if kind == "min":
        return F.least(before, local)
    return F.coalesce(local, before)


def carried(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    *,
    key: Sequence[str] = KEY,
    pos: str = "bar_no",
    block: int = BLOCK,
    until: int = 0,
) -> DataFrame:
    """Running values from the start of the series to the row ``until`` away.

    ``specs`` maps an output name to ``(kind, input)`` with kind one of sum, count,
    product, max, min, last (latest non-NULL). ``until=-1`` leaves out the row itself.
    """
    blk = F.floor(F.col(pos) / F.lit(block))
    inputs = {f"_in_{name}": x for name, (_, x) in specs.items()}
    rows = durable(df.withColumns({**inputs, "_blk": blk}))

    def whole(name: str, kind: str) -> Column:
        x = F.col(f"_in_{name}")
        agg = F.max_by(x, F.when(x.isNotNull(), F.col(pos))) if kind == "last" else _LOCAL[kind](x)
        return agg.alias(f"_tot_{name}")

    totals = rows.groupBy(*key, "_blk").agg(*[whole(n, k) for n, (k, _) in specs.items()])
    earlier = (
        (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0)))
        .orderBy("_blk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def prefix(name: str, kind: str) -> Column:
        t = F.col(f"_tot_{name}")
        agg = {"last": lambda c: F.last(c, ignorenulls=True), "count": F.sum}.get(kind, _LOCAL.get(kind))
        return agg(t).over(earlier).alias(f"_pre_{name}")

    prefixes = totals.select(*key, "_blk", *[prefix(n, k) for n, (k, _) in specs.items()])
    inside = Window.partitionBy(*key, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, until)
    out = rows.join(prefixes, [*key, "_blk"])
    values = {}
    for name, (kind, _) in specs.items():
        x = F.col(f"_in_{name}")
        local = F.last(x, ignorenulls=True) if kind == "last" else _LOCAL[kind](x)
        values[name] = _join_parts(kind, F.col(f"_pre_{name}"), local.over(inside))
    helpers = [c for n in specs for c in (f"_in_{n}", f"_pre_{n}")]
    return out.withColumns(values).drop("_blk", *helpers)


def decay_block(alphas: Sequence[float]) -> int:
    """Largest block in which the weights of a decaying average stay within 1e±110."""
    steepest = max(-math.log1p(-a) for a in alphas)
    return max(2, min(2048, int(250 / steepest)))


def _decayed_total(parts: Column, now: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, e: acc + e["c"] * F.exp(e["cum"] - now))


def ewm(
    df: DataFrame,
    specs: dict[str, tuple[str | Column, float, int]],
    *,
    key: Sequence[str] = KEY,
    pos: str = "bar_no",
    block: int | None = None,
) -> DataFrame:
    """Recursive exponentially weighted means, ``{out: (input, alpha, min_periods)}``.

    The recurrence is y = A*y_prev + b with A = d/(d+alpha), b = alpha*x/(d+alpha),
    d = (1-alpha)^gap, seeded by the first value; rows without a value keep the last
    mean. It is affine, so a block is evaluated as a weighted running sum, blocks are
    chained through one summary row each, and the carry is added back.
    """
    size = block or decay_block([a for _, a, _ in specs.values()])
    out = df.withColumns({f"_x_{n}": (F.col(x) if isinstance(x, str) else x) for n, (x, _, _) in specs.items()})
    out = out.withColumn("_blk", F.floor(F.col(pos) / F.lit(size)))
    w = Window.partitionBy(*key, "_blk").orderBy(pos)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)

    first, second = {}, {}
    for n, (_, alpha, _) in specs.items():
        x = F.col(f"_x_{n}")
        at = F.when(x.isNotNull(), F.col(pos))
        gap = F.col(pos) - F.last(at, ignorenulls=True).over(prior)
        first[f"_d_{n}"] = F.when(x.isNotNull(), F.pow(F.lit(1.0 - alpha), gap))
        first[f"_n_{n}"] = F.count(x).over(upto)
        first[f"_f_{n}"] = F.first(
            F.when(x.isNotNull(), F.struct(F.col(pos).alias("p"), x.alias("x"))), ignorenulls=True
        ).over(upto)
        first[f"_lst_{n}"] = F.last(at, ignorenulls=True).over(upto)
        d = F.col(f"_d_{n}")
        second[f"_dec_{n}"] = F.sum(F.coalesce(-F.ln(d / (d + alpha)), F.lit(0.0))).over(upto)
    out = out.withColumns(first).withColumns(second)
    third = {}
    for n, (_, alpha, _) in specs.items():
        d, x, big = F.col(f"_d_{n}"), F.col(f"_x_{n}"), F.col(f"_dec_{n}")
        b = F.coalesce(alpha * x / (d + alpha), F.lit(0.0))
        third[f"_y_{n}"] = F.exp(-big) * F.sum(b * F.exp(big)).over(upto)
    third["_end"] = F.lead(pos).over(w).isNull()
    out = durable(out.withColumns(third))

    parts = [
        F.struct(*[F.col(f"_{p}_{n}").alias(p) for p in ("n", "f", "lst", "dec", "y")]).alias(f"_s_{n}") for n in specs
    ]
    chain = out.where("_end").select(*key, "_blk", *parts)
    along = Window.partitionBy(*key).orderBy("_blk")
    back = along.rowsBetween(Window.unboundedPreceding, -1)
    a1, a2, a3, keep = {}, {}, {}, []
    for n, (_, alpha, _) in specs.items():
        s = F.col(f"_s_{n}")
        d = F.pow(F.lit(1.0 - alpha), s["f"]["p"] - F.last(s["lst"], ignorenulls=True).over(back))
        a1[f"_g_{n}"] = d
        seeded = F.col(f"_g_{n}").isNotNull()
        g = F.col(f"_g_{n}")
        a2[f"_coef_{n}"] = F.when(seeded, g / (g + alpha))
        a2[f"_b_{n}"] = F.when(seeded, alpha * s["f"]["x"] / (g + alpha)).otherwise(s["f"]["x"])
        a2[f"_cum_{n}"] = F.sum(F.coalesce(s["dec"] - F.coalesce(F.ln(g / (g + alpha)), F.lit(0.0)), F.lit(0.0))).over(
            along.rowsBetween(Window.unboundedPreceding, 0)
        )
        a2[f"_c_{n}"] = F.when(s["n"] > 0, s["y"] + F.exp(-s["dec"]) * F.col(f"_b_{n}"))
    chain = chain.withColumns(a1).withColumns({k: v for k, v in a2.items() if not k.startswith("_c_")})
    chain = chain.withColumns({k: v for k, v in a2.items() if k.startswith("_c_")})
    for n in specs:
        big = F.col(f"_cum_{n}")
        # weights below exp(-745) are zero in double precision, so this frame is exact
        reach = Window.partitionBy(*key).orderBy(f"_cum_{n}").rangeBetween(-746, 0)
        seen = F.collect_list(F.when(F.col(f"_c_{n}").isNotNull(), F.struct(big.alias("cum"), F.col(f"_c_{n}").alias("c"))))
        a3[f"_acc_{n}"] = _decayed_total(seen.over(reach), big)
    chain = chain.withColumns(a3)
    for n in specs:
        has = F.col(f"_s_{n}")["n"] > 0
        carry = F.last(F.when(has, F.col(f"_acc_{n}")), ignorenulls=True).over(back)
        count = F.coalesce(F.sum(F.col(f"_s_{n}")["n"]).over(back), F.lit(0))
        keep.append(
            F.struct(
                carry.alias("y"), count.alias("n"),
                (F.coalesce(F.col(f"_coef_{n}") * carry, F.lit(0.0)) + F.col(f"_b_{n}")).alias("first"),
            ).alias(f"_k_{n}")
        )
    chain = chain.select(*key, "_blk", *keep)
    out = out.join(chain, [*key, "_blk"])
    result, junk = {}, ["_blk", "_end"]
    for n, (_, _, need) in specs.items():
        k = F.col(f"_k_{n}")
        y = F.when(F.col(f"_n_{n}") > 0, F.col(f"_y_{n}") + F.exp(-F.col(f"_dec_{n}")) * k["first"]).otherwise(k["y"])
        result[n] = F.when(k["n"] + F.col(f"_n_{n}") >= max(need, 1), y)
        junk += [f"_{p}_{n}" for p in ("x", "d", "n", "f", "lst", "dec", "y", "k")]
    return out.withColumns(result).drop(*junk)
