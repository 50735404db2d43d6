"""Signals to positions, returns, equity, trades and portfolios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators.indicators import atr_simple_prior, pct_change
from barloom.operators.joins import calendar
from barloom.operators.layout import BLOCK, Frame, carried, number_rows, over_blocks
from barloom.operators.metrics import annualisation
from barloom.session import attach, durable

LONG_ONLY = {"long", "long_only", "long-only"}


@dataclass(frozen=True)
class Rules:
    """How a signal is traded. Costs in basis points; ``vol_lag=1`` sizes by prior bars only."""

    mode: str = "long_short"
    delay: int = 1
    cost_bps: float = 5.0
    slippage_bps: float = 0.0
    vol_target: float | None = None
    vol_lookback: int = 20
    max_leverage: float = 1.0
    initial_equity: float = 1.0
    vol_lag: int = 0

    @property
    def cost_rate(self) -> float:
        return (self.cost_bps + self.slippage_bps) / 10_000.0


def direction(signal: str | Column, mode: str = "long_short") -> Column:
    """-1, 0 or 1; halves round to even; a missing signal is flat."""
    s = F.coalesce(F.col(signal) if isinstance(signal, str) else signal, F.lit(0.0)).cast("double")
    d = F.rint(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))
    return F.when(d > 0, 1.0).otherwise(0.0) if mode.strip().lower() in LONG_ONLY else d


def align_signals(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Signal of each bar, 0 where there is none."""
    out = bars.drop("signal").join(signals.select("symbol", "ts", "signal"), ["symbol", "ts"], "left")
    return out.withColumn("signal", F.coalesce("signal", F.lit(0.0)))


def with_ann(bars: DataFrame) -> DataFrame:
    """Annualisation factor of each symbol, joined back by symbol."""
    a = bars.groupBy("symbol").agg(
        annualisation(F.count(F.lit(1)), F.min("ts"), F.max("ts")).alias("_ann")
    )
    return attach(bars, a)


def positions(bars: DataFrame, rules: Rules = Rules(), *, price: str = "close", block: int = BLOCK) -> DataFrame:
    """Adds ret, signal, position: direction, then delay, then optional volatility target."""
    lb = max(5, rules.vol_lookback)
    bars = bars.withColumn("signal", direction("signal", rules.mode))
    if rules.vol_target is not None:
        bars = with_ann(bars)

    def base(f: Frame) -> dict[str, Column]:
        held = F.coalesce(f.lag("signal", rules.delay), F.lit(0.0)) if rules.delay > 0 else F.col("signal")
        return {"ret": pct_change(f, price), "position": held}

    def realised(f: Frame) -> dict[str, Column]:
        return {"_rv": f.full(F.stddev_pop, F.col("ret"), lb)}

    def lagged(f: Frame) -> dict[str, Column]:
        return {"_rv": f.lag("_rv", rules.vol_lag)}

    steps = [base] + ([realised] if rules.vol_target is not None else [])
    if rules.vol_target is not None and rules.vol_lag > 0:
        steps.append(lagged)
    out = over_blocks(bars, *steps, back=lb + rules.delay + rules.vol_lag + 1, block=block)
    if rules.vol_target is not None:
        target = F.coalesce(F.lit(rules.vol_target) / F.sqrt("_ann"), F.lit(rules.vol_target))
        scale = F.least(F.greatest(ratio(target, "_rv"), F.lit(0.0)), F.lit(rules.max_leverage))
        scale = F.when(F.col("_rv") > 0, scale).otherwise(0.0)
        out = out.withColumn("position", F.col("position") * scale).drop("_rv", "_ann")
    return out


def compound(curve: DataFrame, *, ret: str = "strategy_ret", initial: float = 1.0, key=("symbol",), block: int = BLOCK) -> DataFrame:
    """Equity from per-bar returns; the first row's return is left out."""
    factor = F.when(F.col("bar_no") == 0, F.lit(1.0)).otherwise(1.0 + F.coalesce(F.col(ret), F.lit(0.0)))
    out = carried(curve, {"equity": ("product", factor)}, key=key, block=block)
    return out.withColumn("equity", F.col("equity") * F.lit(initial))


def equity_curve(bars: DataFrame, rules: Rules = Rules(), *, price: str = "close", block: int = BLOCK) -> DataFrame:
    """bars with a signal column -> ret, position, turnover, cost, strategy_ret, equity."""
    p = positions(bars, rules, price=price, block=block)
    p = over_blocks(
        p,
        lambda f: {"turnover": F.abs(F.col("position") - F.coalesce(f.lag("position"), F.lit(0.0)))},
        back=1, block=block,
    )
    p = p.withColumn("cost", F.lit(rules.cost_rate) * F.col("turnover"))
    p = p.withColumn("strategy_ret", F.coalesce(F.col("position") * F.col("ret"), F.lit(0.0)) - F.col("cost"))
    return compound(p, initial=rules.initial_equity, block=block)


def segments(rows: DataFrame, value: str = "position", *, by_side: bool = False, block: int = BLOCK) -> DataFrame:
    """Number runs of equal value per symbol (``seg``); ``seg_start`` marks their first rows."""
    v = F.signum(F.col(value)) if by_side else F.col(value)

    def starts(f: Frame) -> dict[str, Column]:
        lagged = f.lag(v)
        return {"seg_start": lagged.isNull() | (lagged != v)}

    marked = over_blocks(rows, starts, back=1, block=block)
    out = carried(marked, {"seg": ("sum", F.col("seg_start").cast("long"))}, block=block)
    return out.withColumn("seg", F.col("seg") - 1)


def trades_from_positions(curve: DataFrame, *, price: str = "close", by_side: bool = False, block: int = BLOCK) -> DataFrame:
    """Closed trades: any change of the position closes the trade and opens the next one.
    A short's return is minus the raw return; a trade still open at the end is not listed."""
    s = segments(curve, by_side=by_side, block=block).where("seg_start").select(
        "symbol", "seg", F.col("ts").alias("entry_ts"), F.col(price).alias("entry_price"), "position"
    )
    s = over_blocks(
        s, lambda f: {"exit_ts": f.lead("entry_ts"), "exit_price": f.lead("entry_price")},
        back=0, ahead=1, pos="seg", block=block,
    )
    raw = ratio("exit_price", "entry_price") - 1.0
    return s.where((F.col("position") != 0) & F.col("exit_ts").isNotNull()).select(
        "symbol", "entry_ts", "exit_ts",
        F.when(F.col("position") > 0, "long").otherwise("short").alias("side"),
        "entry_price", "exit_price", F.when(F.col("position") > 0, raw).otherwise(-raw).alias("ret"),
    )


def mark_return(side: Column, p0: Column, p1: Column) -> Column:
    """Trade return between two marks: p1/p0-1 long, p0/p1-1 short."""
    return F.when(side > 0, ratio(p1, p0) - 1.0).when(side < 0, ratio(p0, p1) - 1.0)


# ---- barrier exits -------------------------------------------------------------------------


@dataclass(frozen=True)
class Barriers:
    stop_loss: float | None = None
    take_profit: float | None = None
    trailing_stop: float | None = None
    trailing_atr_mult: float | None = None
    atr_window: int = 14
    take_profit_first: bool = False

    def on(self, name: str) -> float | None:
        v = getattr(self, name)
        return v if v is not None and v > 0 else None


def _bar_step(b: Barriers):
    """One bar of a held position. State: entry price and bar (NULL when flat), watermark."""
    sl, tp, tr, am = (b.on(n) for n in ("stop_loss", "take_profit", "trailing_stop", "trailing_atr_mult"))
    none = F.lit(None).cast("double")

    def step(acc: Column, r: Column) -> Column:
        is_long = r["side"] > 0
        flat = acc["ep"].isNull()
        ep = F.when(flat, r["p0"]).otherwise(acc["ep"])
        mark = F.when(flat, r["p0"]).otherwise(acc["mark"])
        entry = F.when(flat, r["bar_no"]).otherwise(acc["entry"])
        s = F.when(is_long, 1.0).otherwise(-1.0)

        def tighter(x: Column, y: Column) -> Column:
            return F.when(is_long, F.greatest(x, y)).otherwise(F.least(x, y))

        fixed = ep * (1.0 - s * sl) if sl else none
        trail = mark * (1.0 - s * tr) if tr else none
        stop = tighter(fixed, trail)
        by_atr = F.when(r["atr"] > 0, mark - s * am * r["atr"]) if am else none
        atr_binds = by_atr.isNotNull() & F.coalesce(s * (by_atr - stop) > 0, stop.isNull())
        trail_price = F.when(atr_binds, by_atr).otherwise(trail)
        trail_kind = F.when(atr_binds, "trailing_atr").otherwise("trailing_stop")
        stop = tighter(stop, by_atr)
        target = ep * (1.0 + s * tp) if tp else none
        hit_stop = F.coalesce(F.when(is_long, r["low"] <= stop).otherwise(r["high"] >= stop), F.lit(False))
        hit_tp = F.coalesce(F.when(is_long, r["high"] >= target).otherwise(r["low"] <= target), F.lit(False))
        use_tp = hit_tp & (F.lit(True) if b.take_profit_first else ~hit_stop)
        hit = hit_stop | hit_tp
        reason = (
            F.when(use_tp, "take_profit")
            .when(hit_stop & F.coalesce(F.abs(stop - trail_price) <= 1e-9, F.lit(False)), trail_kind)
            .when(hit_stop, "stop_loss")
        )
        exit_price = F.when(use_tp, target).when(hit_stop, stop)
        best = F.when(is_long, F.greatest(mark, r["high"])).otherwise(F.least(mark, r["low"]))
        done = F.struct(
            r["bar_no"].alias("bar_no"), entry.alias("entry_bar"), ep.alias("entry_price"),
            exit_price.alias("barrier_price"), reason.alias("exit_reason"),
        )
        return F.struct(
            F.when(~hit, ep).alias("ep"), F.when(~hit, entry).alias("entry"), F.when(~hit, best).alias("mark"),
            F.concat(acc["out"], F.array(done)).alias("out"),
        )

    return step


_STATE = "struct<ep:double,entry:bigint,mark:double,out:array<struct<bar_no:bigint,entry_bar:bigint,entry_price:double,barrier_price:double,exit_reason:string>>>"


def barrier_bars(
    bars: DataFrame, rules: Rules = Rules(), barriers: Barriers = Barriers(), *, mark: str = "open",
    chunk: int = 512, block: int = BLOCK,
) -> DataFrame:
    """Per-bar result of trading a signal with stops, take profit and trailing stops.

    Runs of one desired position are independent of each other, so a run is the unit of
    work. Within it the exits depend on the path; the run is cut into chunks of at most
    ``chunk`` bars, each one array folded by ``aggregate`` in the JVM, and the state after
    a chunk (entry price and bar, watermark) is joined to the next chunk of the run. Most
    runs have one chunk; the loop runs once per chunk of the longest run.
    """
    b = atr_simple_prior(bars, barriers.atr_window, block=block) if barriers.on("trailing_atr_mult") else bars.withColumn(
        "atr_prev", F.lit(None).cast("double")
    )
    p = positions(b, rules, price=mark, block=block).withColumnRenamed("position", "desired_pos")
    p = over_blocks(p, lambda f: {"price_next": f.lead(mark)}, back=0, ahead=1, block=block)
    p = p.where(F.col("price_next").isNotNull()).withColumn("price", F.col(mark))
    p = segments(p, "desired_pos", block=block)
    p = durable(
        carried(p, {"_seg_bar": ("last", F.when(F.col("seg_start"), F.col("bar_no")))}, block=block)
        .withColumn("_chunk", F.floor((F.col("bar_no") - F.col("_seg_bar")) / F.lit(chunk)))
        .select("symbol", "ts", "bar_no", "high", "low", "signal", "desired_pos", "price", "price_next", "atr_prev", "seg", "_chunk")
    )
    held = p.where(F.col("desired_pos") != 0).groupBy("symbol", "seg", "_chunk").agg(
        F.array_sort(
            F.collect_list(
                F.struct("bar_no", F.col("price").alias("p0"), "high", "low", F.col("desired_pos").alias("side"), F.col("atr_prev").alias("atr"))
            )
        ).alias("_rows")
    )
    chunks = (held.agg(F.max("_chunk")).first()[0] or 0) + 1
    held = durable(held) if chunks > 1 else held
    fresh = F.lit(None).cast(_STATE)
    state, done = None, None
    for c in range(chunks):
        now = held.where(F.col("_chunk") == c) if chunks > 1 else held
        if state is None:
            now = now.withColumn("_from", fresh)
        else:
            now = now.join(state, ["symbol", "seg"])
        begin = F.struct(
            F.col("_from.ep").alias("ep"), F.col("_from.entry").alias("entry"), F.col("_from.mark").alias("mark"),
            F.array().cast("array<struct<bar_no:bigint,entry_bar:bigint,entry_price:double,barrier_price:double,exit_reason:string>>").alias("out"),
        )
        folded = now.select("symbol", "seg", F.aggregate("_rows", begin, _bar_step(barriers)).alias("_s"))
        folded = durable(folded) if chunks > 1 else folded
        state = folded.select(
            "symbol", "seg",
            F.struct("_s.ep", "_s.entry", "_s.mark", F.array().cast("array<struct<bar_no:bigint,entry_bar:bigint,entry_price:double,barrier_price:double,exit_reason:string>>").alias("out")).alias("_from"),
        )
        part = folded.select("symbol", F.inline("_s.out"))
        done = part if done is None else done.unionByName(part)
    return p.drop("_chunk", "atr_prev").join(done, ["symbol", "bar_no"], "left")


def barrier_curve(rows: DataFrame, rules: Rules = Rules(), *, block: int = BLOCK) -> DataFrame:
    """Turnover, cost, returns and equity of ``barrier_bars`` rows."""
    stopped = F.col("exit_reason").isNotNull()
    d = F.col("desired_pos")
    out = over_blocks(
        rows,
        lambda f: {
            "_prev": F.coalesce(f.lag(F.when(stopped, F.lit(0.0)).otherwise(d)), F.lit(0.0)),
        },
        back=1, block=block,
    )
    exit_at = F.coalesce("barrier_price", "price_next")
    gross = F.abs(d) * F.coalesce(mark_return(d, F.col("price"), exit_at), F.lit(0.0))
    rebalance = F.abs(d - F.col("_prev"))
    leave = F.when(stopped, F.abs(d)).otherwise(0.0)
    out = out.withColumns(
        {
            "position": F.when(stopped, 0.0).otherwise(d),
            "turnover": rebalance + leave,
            "cost": F.lit(rules.cost_rate) * (rebalance + leave),
            "gross_ret": gross,
            "event": F.coalesce(
                "exit_reason", F.when((F.col("_prev") != 0) & (F.col("_prev") != d), F.lit("signal"))
            ),
        }
    ).withColumn("strategy_ret", F.col("gross_ret") - F.col("cost"))
    factor = 1.0 + F.col("strategy_ret")
    out = carried(out, {"equity": ("product", factor)}, block=block)
    return out.withColumn("equity", F.col("equity") * rules.initial_equity).drop("_prev")


def barrier_trades(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Trades of ``barrier_bars`` rows with exit reasons; open trades are not listed."""
    r = over_blocks(
        rows,
        lambda f: {"_next_seg": f.lead("seg"), "_next_ts": f.lead("ts"), "_next_price": f.lead("price")},
        back=0, ahead=1, block=block,
    )
    # a run that ends while its trade is open is closed at the next bar's mark
    stopped = F.col("exit_reason").isNotNull()
    by_signal = ~stopped & (F.col("_next_seg") != F.col("seg"))
    out = r.where(F.col("entry_bar").isNotNull() & (stopped | by_signal)).select(
        "symbol", "entry_bar", F.when(stopped, F.col("ts")).otherwise(F.col("_next_ts")).alias("exit_ts"),
        F.when(F.col("desired_pos") > 0, "long").otherwise("short").alias("side"), "entry_price",
        F.when(stopped, F.col("barrier_price")).otherwise(F.col("_next_price")).alias("exit_price"),
        mark_return(
            F.col("desired_pos"), F.col("entry_price"),
            F.when(stopped, F.col("barrier_price")).otherwise(F.col("_next_price")),
        ).alias("ret"),
        F.coalesce("exit_reason", F.lit("signal")).alias("exit_reason"),
    )
    entries = rows.select("symbol", F.col("bar_no").alias("entry_bar"), F.col("ts").alias("entry_ts"))
    return out.join(entries, ["symbol", "entry_bar"]).select(
        "symbol", "entry_ts", "exit_ts", "side", "entry_price", "exit_price", "ret", "exit_reason"
    )


# ---- portfolio -----------------------------------------------------------------------------


def portfolio_weights(
    returns: DataFrame, *, weighting: str = "equal", lookback: int = 20, vol_lag: int = 0, step_seconds: int = 86_400,
    block: int = BLOCK,
) -> DataFrame:
    """Equal weights, or inverse rolling deviation normalised over the timestamp; a timestamp
    without any deviation is equally weighted. Adds weight and n_assets.

    ``returns`` holds symbol, ts, bar_no, strategy_ret. A deviation needs ``lookback`` rows on
    consecutive calendar timestamps. A symbol that misses a timestamp has weight 0 there and no
    row, so the timestamp x symbol grid is never built.
    """
    lb = max(5, lookback)
    n = returns.agg(F.count_distinct("symbol").alias("n_assets"))
    g = returns.join(F.broadcast(n))
    if weighting.strip().lower() not in {"inv_vol", "inverse_vol", "inverse-vol", "risk_parity"}:
        return g.withColumn("weight", 1.0 / F.col("n_assets"))
    g = g.join(calendar(returns, step_seconds=step_seconds), "ts")

    def deviation(f: Frame) -> dict[str, Column]:
        unbroken = F.col("t_no") - f.lag("t_no", lb - 1) == lb - 1
        return {"_v": F.when(unbroken, f.full(F.stddev_pop, F.col("strategy_ret"), lb)), "_t": f.lag("t_no", max(vol_lag, 1))}

    def lagged(f: Frame) -> dict[str, Column]:
        return {"_v": F.when(F.col("t_no") - F.col("_t") == 1, f.lag("_v"))}

    g = over_blocks(g, deviation, *([lagged] if vol_lag else []), back=lb + vol_lag, block=block)
    inv = g.withColumn("_inv", ratio(F.lit(1.0), "_v"))
    sums = inv.groupBy("ts").agg(F.sum("_inv").alias("_sum"))
    w = F.when(F.col("_sum").isNull(), 1.0 / F.col("n_assets")).otherwise(F.coalesce(ratio("_inv", "_sum"), F.lit(0.0)))
    return inv.join(sums, "ts").withColumn("weight", w).drop("_v", "_t", "_inv", "_sum", "t_no")


def portfolio_curve(weighted: DataFrame, *, step_seconds: int = 86_400, block: int = BLOCK) -> DataFrame:
    """Weighted return per timestamp, missing returns skipped, compounded."""
    r = weighted.groupBy("ts").agg(F.coalesce(F.sum(F.col("weight") * F.col("strategy_ret")), F.lit(0.0)).alias("strategy_ret"))
    r = number_rows(r.withColumn("symbol", F.lit("portfolio")), step_seconds=step_seconds)
    return compound(r, block=block)


def asset_metrics(curve_rows: DataFrame, trade_rows: DataFrame) -> DataFrame:
    return curve_rows.join(trade_rows.select("symbol", "n_trades", "win_rate", "profit_factor"), "symbol", "left").fillna(
        0, ["n_trades"]
    )
