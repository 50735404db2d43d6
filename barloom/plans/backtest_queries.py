"""Queries on positions, equity, trades, barrier exits and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import metrics as mx
from barloom.operators.layout import over_blocks
from barloom.plans.inputs import SQL_EVENT_BARS, SQL_SHIP_BARS, event_bars, rounded, ship_bars, sql_select
from barloom.plans.strategy import SQL_SIGNAL, crossover_signal
from barloom.session import durable

QUERIES, ORACLES = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


W = "OVER (PARTITION BY symbol ORDER BY bar_no)"
ANN = """(CASE WHEN count(*) OVER (PARTITION BY symbol) >= 3 THEN count(*) OVER (PARTITION BY symbol) /
   ((epoch_us(max(ts) OVER (PARTITION BY symbol)) - epoch_us(min(ts) OVER (PARTITION BY symbol))) / 86400000000.0::DOUBLE / 365.25::DOUBLE) END)"""


def sql_curve(*, long_only=False, delay=1, vol_target=None, price="close", lb=20, lev=1.0, vol_lag=0):
    """signal -> position -> equity, over the CTE sig."""
    d = "CASE WHEN signal > 0 THEN 1.0::DOUBLE ELSE 0.0 END" if long_only else "signal"
    scale = "1.0::DOUBLE"
    if vol_target is not None:
        scale = f"coalesce(least(greatest(({vol_target} / sqrt(ann)) / nullif(rv, 0), 0), {lev}), 0)"
    lag = f"lag(rv, {vol_lag}) {W}" if vol_lag else "rv"
    return f""",
 c0 AS (SELECT *, {price} / nullif(lag({price}) {W}, 0) - 1 AS ret, {d} AS dir, {ANN} AS ann FROM sig),
 c1 AS (SELECT *, coalesce(lag(dir, {delay}) {W}, 0) AS held, CASE WHEN count(ret) OVER l >= {lb} THEN stddev_pop(ret) OVER l END AS rv
   FROM c0 WINDOW l AS (PARTITION BY symbol ORDER BY bar_no ROWS {lb - 1} PRECEDING)),
 c2 AS (SELECT * EXCLUDE (rv), {lag} AS rv FROM c1),
 c3 AS (SELECT *, held * {scale} AS position FROM c2),
 c4 AS (SELECT *, abs(position - coalesce(lag(position) {W}, 0)) AS turnover FROM c3),
 c5 AS (SELECT *, 0.0005::DOUBLE * turnover AS cost, coalesce(position * ret, 0) - 0.0005::DOUBLE * turnover AS strategy_ret FROM c4),
 curve AS (SELECT *, product(CASE WHEN bar_no = 0 THEN 1.0::DOUBLE ELSE 1 + strategy_ret END) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS equity FROM c5)"""


CURVE = "close ret signal position turnover cost strategy_ret equity"
SQL_METRICS = f""",
 dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
   coalesce(position <> lag(position) {W}, false) AS moved FROM curve),
 m0 AS (SELECT symbol, min(ts) AS start, max(ts) AS "end", count(*) AS n_bars, arg_max(equity, bar_no) / arg_min(equity, bar_no) AS growth,
   min(drawdown) AS max_drawdown, avg(strategy_ret) AS avg_bar_return, stddev_pop(strategy_ret) AS vol_bar, sum(turnover) AS turnover_sum,
   count(*) FILTER (moved) AS n_position_changes, any_value(ann) AS ann_factor FROM dd GROUP BY 1),
 met AS (SELECT *, growth - 1 AS total_return, CASE WHEN date_diff('hour', start, "end") // 24 > 0 THEN
     pow(growth, 365.25 / (date_diff('hour', start, "end") // 24)) - 1 END AS cagr,
   CASE WHEN vol_bar > 0 THEN avg_bar_return / vol_bar * sqrt(ann_factor) END AS sharpe FROM m0)"""
METRICS = "total_return cagr max_drawdown ann_factor sharpe avg_bar_return vol_bar turnover_sum"
MPLAIN = 'symbol start "end" n_bars n_position_changes'


def curve_of(s, d, rules=bt.Rules(), price="close", bars=event_bars):
    return bt.equity_curve(crossover_signal(bars(s, d)), rules, price=price)


def curve_cols(df):
    return rounded(df.select("symbol", "ts", *CURVE.split()))


def sql_out(ctes, body, names, plain="symbol ts"):
    return f"WITH RECURSIVE {ctes} SELECT {sql_select(names, plain=plain)} FROM {body}"


add("crossover_signal", lambda s, d: rounded(crossover_signal(event_bars(s, d)).select("symbol", "ts", "sma_20", "sma_50", "bb_pos", "signal")),
    sql_out(SQL_EVENT_BARS + SQL_SIGNAL, "sig", "sma_20 sma_50 bb_pos signal"))
add("equity_curve", lambda s, d: curve_cols(curve_of(s, d)), sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_curve(), "curve", CURVE))
add("equity_curve_long_only", lambda s, d: curve_cols(curve_of(s, d, bt.Rules(mode="long_only", delay=2))),
    sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_curve(long_only=True, delay=2), "curve", CURVE.replace("signal", "dir")).replace("round(dir, 6) AS dir", "round(dir, 6) AS signal"))
add("equity_curve_open_marks", lambda s, d: curve_cols(curve_of(s, d, price="open")),
    sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_curve(price="open"), "curve", CURVE))
add("vol_target", lambda s, d: curve_cols(curve_of(s, d, bt.Rules(vol_target=2.0))),
    sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_curve(vol_target=2.0), "curve", CURVE))
add("vol_target_prior_bar", lambda s, d: curve_cols(curve_of(s, d, bt.Rules(vol_target=2.0, vol_lag=1, max_leverage=2.0))),
    sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_curve(vol_target=2.0, vol_lag=1, lev=2.0), "curve", CURVE))


def metrics_of(curve):
    return rounded(mx.curve_metrics(curve))


add("flagship", lambda s, d: metrics_of(curve_of(s, d, bars=ship_bars)),
    sql_out(SQL_SHIP_BARS + SQL_SIGNAL + sql_curve() + SQL_METRICS, "met", METRICS, MPLAIN))
# a month of hourly bars has no meaningful yearly growth; the flagship covers it on years of bars
add("curve_metrics", lambda s, d: metrics_of(curve_of(s, d)).drop("cagr"),
    sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_curve() + SQL_METRICS, "met", METRICS.replace("cagr ", ""), MPLAIN))
add("drawdowns", lambda s, d: rounded(mx.drawdowns(curve_of(s, d)).select("symbol", "ts", "equity", "drawdown")),
    sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_curve() + SQL_METRICS, "dd", "equity drawdown"))


def ann(s, d):
    b = bt.with_ann(event_bars(s, d)).groupBy("symbol").agg(F.max("_ann").alias("ann_factor"))
    return rounded(b)


add("annualisation", ann, f"WITH {SQL_EVENT_BARS} SELECT DISTINCT symbol, round({ANN}, 6) AS ann_factor FROM bars")

SQL_TRADES = f""",
 ch AS (SELECT *, CASE WHEN lag(position) {W} IS NULL OR lag(position) {W} <> position THEN 1 ELSE 0 END AS chg FROM curve),
 sg AS (SELECT symbol, ts AS entry_ts, close AS entry_price, position, lead(ts) {W} AS exit_ts, lead(close) {W} AS exit_price FROM ch WHERE chg = 1),
 trades AS (SELECT symbol, entry_ts, exit_ts, CASE WHEN position > 0 THEN 'long' ELSE 'short' END AS side, entry_price, exit_price,
   CASE WHEN position > 0 THEN exit_price / entry_price - 1 ELSE -(exit_price / entry_price - 1) END AS ret FROM sg WHERE position <> 0 AND exit_ts IS NOT NULL)"""
TRADES = "entry_price exit_price ret"
TPLAIN = "symbol entry_ts exit_ts side"
add("trade_list", lambda s, d: rounded(bt.trades_from_positions(curve_of(s, d))),
    sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_curve() + SQL_TRADES, "trades", TRADES, TPLAIN))
SQL_TM = """,
 tm0 AS (SELECT symbol, count(*) AS n_trades, count(*) FILTER (ret > 0) AS n_wins, count(*) FILTER (ret < 0) AS n_losses, count(*) FILTER (ret = 0) AS n_breakeven,
   avg(ret) FILTER (ret > 0) AS avg_win, avg(ret) FILTER (ret < 0) AS avg_loss, coalesce(sum(ret) FILTER (ret > 0), 0) AS up,
   coalesce(-sum(ret) FILTER (ret < 0), 0) AS down, avg(ret) AS expectancy, median(ret) AS median_trade_return FROM trades GROUP BY 1),
 tm AS (SELECT *, n_wins / n_trades AS win_rate, CASE WHEN n_losses > 0 THEN n_wins / n_losses WHEN n_wins > 0 THEN 'inf'::DOUBLE END AS win_loss_ratio,
   CASE WHEN down > 0 THEN up / down WHEN up > 0 THEN 'inf'::DOUBLE END AS profit_factor FROM tm0)"""
TM = "win_rate win_loss_ratio avg_win avg_loss profit_factor expectancy median_trade_return"
TMPLAIN = "symbol n_trades n_wins n_losses n_breakeven"
add("trade_metrics", lambda s, d: rounded(mx.trade_metrics(bt.trades_from_positions(curve_of(s, d)))),
    sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_curve() + SQL_TRADES + SQL_TM, "tm", TM, TMPLAIN))


def per_asset(s, d):
    curve = durable(curve_of(s, d))
    return rounded(
        bt.asset_metrics(mx.curve_metrics(curve), mx.trade_metrics(bt.trades_from_positions(curve)))
        .select("symbol", "n_bars", "total_return", "sharpe", "n_trades", "win_rate", "profit_factor")
    )


add("asset_metrics", per_asset,
    sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_curve() + SQL_METRICS + SQL_TRADES + SQL_TM, "met LEFT JOIN tm USING (symbol)",
            "total_return sharpe win_rate profit_factor", "symbol n_bars n_trades"))

# ---- barriers: one state machine per symbol in SQL ------------------------------------------
BAR = bt.Barriers(stop_loss=0.02, take_profit=0.08)
TRAIL = bt.Barriers(stop_loss=0.06, trailing_stop=0.08, trailing_atr_mult=0.8)
DAILY = bt.Barriers(stop_loss=0.03, take_profit=0.05, take_profit_first=True)


def sql_barriers(b: bt.Barriers):
    n = "NULL::DOUBLE"
    fixed = f"ep * (1 - s * {b.stop_loss})" if b.stop_loss else n
    trail = f"mk * (1 - s * {b.trailing_stop})" if b.trailing_stop else n
    atr = f"CASE WHEN atr > 0 THEN mk - s * {b.trailing_atr_mult} * atr END" if b.trailing_atr_mult else n
    tgt = f"ep * (1 + s * {b.take_profit})" if b.take_profit else n
    tp_wins = "hit_tp" if b.take_profit_first else "hit_tp AND NOT hit_stop"
    return f""",
 tr0 AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) {W}, high)), abs(low - coalesce(lag(close) {W}, low))) AS tr,
   coalesce(lag(signal) {W}, 0) AS want, lead(open) {W} AS p1 FROM sig),
 tr1 AS (SELECT *, CASE WHEN count(tr) OVER l >= 14 THEN avg(tr) OVER l END AS atr0 FROM tr0 WINDOW l AS (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING)),
 bx AS (SELECT symbol, ts, bar_no, open AS p0, p1, high, low, want, lag(atr0) {W} AS atr FROM tr1),
 walk AS (
   SELECT symbol, -1::BIGINT AS bar_no, 0.0::DOUBLE AS pos, {n} AS ep, -1::BIGINT AS entry_bar, {n} AS mk, {n} AS want, {n} AS prev, {n} AS entry_price,
     {n} AS barrier_price, NULL::VARCHAR AS exit_reason, -1::BIGINT AS this_entry FROM bx WHERE bar_no = 0
   UNION ALL
   SELECT symbol, bar_no, CASE WHEN hit THEN 0 ELSE want END, CASE WHEN want <> 0 AND NOT hit THEN ep END, this_entry,
     CASE WHEN s > 0 THEN greatest(mk, high) ELSE least(mk, low) END, want, prev, ep,
     CASE WHEN use_tp THEN target WHEN hit_stop THEN stop END,
     CASE WHEN use_tp THEN 'take_profit' WHEN hit_stop AND abs(stop - trail_price) <= 1e-9 THEN kind WHEN hit_stop THEN 'stop_loss' END, this_entry
   FROM (SELECT *, hit_stop OR hit_tp AS hit, ({tp_wins}) AS use_tp FROM (
     SELECT *, want <> 0 AND coalesce(CASE WHEN s > 0 THEN low <= stop ELSE high >= stop END, false) AS hit_stop,
       want <> 0 AND coalesce(CASE WHEN s > 0 THEN high >= target ELSE low <= target END, false) AS hit_tp FROM (
     SELECT *, CASE WHEN s > 0 THEN greatest(st1, by_atr) ELSE least(st1, by_atr) END AS stop,
       CASE WHEN by_atr IS NOT NULL AND (st1 IS NULL OR s * (by_atr - st1) > 0) THEN by_atr ELSE trail END AS trail_price,
       CASE WHEN by_atr IS NOT NULL AND (st1 IS NULL OR s * (by_atr - st1) > 0) THEN 'trailing_atr' ELSE 'trailing_stop' END AS kind FROM (
     SELECT *, CASE WHEN s > 0 THEN greatest({fixed}, trail) ELSE least({fixed}, trail) END AS st1 FROM (
     SELECT *, {trail} AS trail, {atr} AS by_atr, {tgt} AS target FROM (
     SELECT b.symbol, b.bar_no, b.p0, b.high, b.low, b.want, b.atr, sign(b.want) AS s, w.pos AS prev,
       CASE WHEN b.want <> 0 THEN CASE WHEN w.pos <> b.want THEN b.p0 ELSE w.ep END END AS ep,
       CASE WHEN b.want <> 0 THEN CASE WHEN w.pos <> b.want THEN b.p0 ELSE w.mk END END AS mk,
       CASE WHEN w.pos <> b.want THEN b.bar_no ELSE w.this_entry END AS this_entry
     FROM walk w JOIN bx b ON b.symbol = w.symbol AND b.bar_no = w.bar_no + 1 WHERE b.p1 IS NOT NULL)))))) q),
 bars1 AS (SELECT w.symbol, x.ts, w.bar_no, x.p0 AS price, x.p1 AS price_next, w.want AS desired_pos, w.prev, w.entry_price, w.this_entry AS entry_bar,
     w.barrier_price, w.exit_reason FROM walk w JOIN bx x USING (symbol, bar_no)),
 g1 AS (SELECT *, CASE WHEN exit_reason IS NOT NULL THEN 0 ELSE desired_pos END AS position,
   abs(desired_pos - prev) + CASE WHEN exit_reason IS NOT NULL THEN abs(desired_pos) ELSE 0 END AS turnover,
   CASE WHEN desired_pos > 0 THEN coalesce(barrier_price, price_next) / price - 1 WHEN desired_pos < 0 THEN price / coalesce(barrier_price, price_next) - 1 ELSE 0 END AS gross_ret,
   coalesce(exit_reason, CASE WHEN prev <> 0 AND prev <> desired_pos THEN 'signal' END) AS event FROM bars1),
 g2 AS (SELECT *, 0.0005::DOUBLE * turnover AS cost, gross_ret - 0.0005::DOUBLE * turnover AS strategy_ret FROM g1),
 g AS (SELECT *, product(1 + strategy_ret) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS equity FROM g2),
 x0 AS (SELECT *, lead(ts) {W} AS nts, lead(price) {W} AS np, lead(desired_pos) {W} AS nd FROM g),
 x1 AS (SELECT symbol, entry_bar, desired_pos, entry_price, CASE WHEN exit_reason IS NOT NULL THEN ts ELSE nts END AS exit_ts,
   CASE WHEN exit_reason IS NOT NULL THEN barrier_price ELSE np END AS exit_price, coalesce(exit_reason, 'signal') AS exit_reason
   FROM x0 WHERE desired_pos <> 0 AND (exit_reason IS NOT NULL OR nd <> desired_pos)),
 xt AS (SELECT x1.symbol, e.ts AS entry_ts, exit_ts, CASE WHEN desired_pos > 0 THEN 'long' ELSE 'short' END AS side, entry_price, exit_price,
   CASE WHEN desired_pos > 0 THEN exit_price / entry_price - 1 ELSE entry_price / exit_price - 1 END AS ret, exit_reason
   FROM x1 JOIN bx e ON e.symbol = x1.symbol AND e.bar_no = x1.entry_bar)"""


def barrier_rows(s, d, b, bars=event_bars):
    return bt.barrier_bars(crossover_signal(bars(s, d)), bt.Rules(), b)


BC = "price price_next desired_pos position turnover cost gross_ret strategy_ret equity"
for name, b in (("barrier_curve", BAR), ("barrier_curve_trailing", TRAIL)):
    add(name, lambda s, d, b=b: rounded(bt.barrier_curve(barrier_rows(s, d, b)).select("symbol", "ts", "event", *BC.split())),
        sql_out(SQL_EVENT_BARS + SQL_SIGNAL + sql_barriers(b), "g", BC, "symbol ts event"))
for name, b in (("barrier_reentry", BAR), ("barrier_reentry_trailing", TRAIL), ("barrier_take_profit_first", DAILY)):
    src, text = (ship_bars, SQL_SHIP_BARS) if b is DAILY else (event_bars, SQL_EVENT_BARS)
    add(name, lambda s, d, b=b, src=src: rounded(bt.barrier_trades(barrier_rows(s, d, b, src))),
        sql_out(text + SQL_SIGNAL + sql_barriers(b), "xt", TRADES, TPLAIN + " exit_reason"))
add("exit_reasons", lambda s, d: mx.exit_reasons(bt.barrier_trades(barrier_rows(s, d, BAR))),
    f"WITH RECURSIVE {SQL_EVENT_BARS} {SQL_SIGNAL} {sql_barriers(BAR)} SELECT symbol, exit_reason, count(*) AS n FROM xt GROUP BY 1, 2")


def first_exit(s, d):
    """First bar per held run that touches the stop or the target, without re-entry."""
    rows = barrier_rows(s, d, BAR)
    first = rows.where("exit_reason IS NOT NULL").groupBy("symbol", "seg").agg(F.min("bar_no").alias("bar_no"))
    return rounded(rows.join(first, ["symbol", "seg", "bar_no"]).select("symbol", "ts", "entry_price", "barrier_price", "exit_reason"))


add("barrier_exits", first_exit,
    f"""WITH RECURSIVE {SQL_EVENT_BARS} {SQL_SIGNAL},
    h0 AS (SELECT *, coalesce(lag(signal) {W}, 0) AS want, lead(open) {W} AS p1 FROM sig),
    h1 AS (SELECT *, CASE WHEN lag(want) {W} IS NULL OR lag(want) {W} <> want THEN 1 ELSE 0 END AS chg FROM h0),
    h2 AS (SELECT *, sum(chg) {W} AS seg FROM h1 WHERE p1 IS NOT NULL),
    h3 AS (SELECT *, first_value(open) OVER (PARTITION BY symbol, seg ORDER BY bar_no) AS ep FROM h2 WHERE want <> 0),
    h4 AS (SELECT *, CASE WHEN want > 0 AND low <= ep * (1 - 0.02) THEN ep * (1 - 0.02) WHEN want < 0 AND high >= ep * (1 + 0.02) THEN ep * (1 + 0.02) END AS st,
      CASE WHEN want > 0 AND high >= ep * (1 + 0.08) THEN ep * (1 + 0.08) WHEN want < 0 AND low <= ep * (1 - 0.08) THEN ep * (1 - 0.08) END AS tp FROM h3)
    SELECT symbol, ts, round(ep, 6) AS entry_price, round(coalesce(st, tp), 6) AS barrier_price,
      CASE WHEN st IS NOT NULL THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason
    FROM h4 WHERE st IS NOT NULL OR tp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, seg ORDER BY bar_no) = 1""")


# ---- portfolio -----------------------------------------------------------------------------
def weighted(s, d, weighting):
    c = durable(curve_of(s, d, bars=ship_bars).select("symbol", "ts", "bar_no", "strategy_ret"))
    return bt.portfolio_weights(c, weighting=weighting)


def sql_portfolio(inverse):
    if inverse:
        w = """,
 ps AS (SELECT DISTINCT ts FROM curve), pn AS (SELECT ts, row_number() OVER (ORDER BY ts) AS t_no FROM ps),
 pg AS (SELECT k.symbol, p.ts, p.t_no, c.strategy_ret FROM pn p CROSS JOIN (SELECT DISTINCT symbol FROM curve) k LEFT JOIN curve c ON c.symbol = k.symbol AND c.ts = p.ts),
 pv AS (SELECT *, CASE WHEN count(strategy_ret) OVER l >= 20 THEN stddev_pop(strategy_ret) OVER l END AS v, count(DISTINCT symbol) OVER () AS n FROM pg
   WINDOW l AS (PARTITION BY symbol ORDER BY t_no ROWS 19 PRECEDING)),
 pi AS (SELECT *, 1 / nullif(v, 0) AS inv FROM pv),
 pw AS (SELECT *, CASE WHEN sum(inv) OVER (PARTITION BY ts) IS NULL THEN 1.0::DOUBLE / n ELSE coalesce(inv / sum(inv) OVER (PARTITION BY ts), 0) END AS weight FROM pi)"""
    else:
        w = ", pw AS (SELECT symbol, ts, strategy_ret, 1.0::DOUBLE / (SELECT count(DISTINCT symbol) FROM curve) AS weight FROM curve)"
    return w + """,
 pr AS (SELECT ts, coalesce(sum(weight * strategy_ret), 0) AS strategy_ret FROM pw GROUP BY ts),
 pe AS (SELECT *, product(CASE WHEN rn = 1 THEN 1.0::DOUBLE ELSE 1 + strategy_ret END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM
   (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM pr))"""


for name, kind in (("portfolio_equity", "equal"), ("portfolio_inverse_vol", "inverse_vol")):
    add(name, lambda s, d, kind=kind: rounded(bt.portfolio_curve(weighted(s, d, kind)).select("ts", "strategy_ret", "equity")),
        sql_out(SQL_SHIP_BARS + SQL_SIGNAL + sql_curve() + sql_portfolio(kind != "equal"), "pe", "strategy_ret equity", "ts"))
add("portfolio_weights", lambda s, d: rounded(weighted(s, d, "inverse_vol").select("symbol", "ts", "weight")),
    sql_out(SQL_SHIP_BARS + SQL_SIGNAL + sql_curve() + sql_portfolio(True), "pw WHERE strategy_ret IS NOT NULL", "weight"))


def joined_signal(s, d):
    """Signals known only for some bars: the rest is flat."""
    b = event_bars(s, d)
    sig = crossover_signal(b).where(F.col("bar_no") % 3 != 0).select("symbol", "ts", "signal")
    return rounded(bt.align_signals(b, sig).select("symbol", "ts", "signal"))


add("signal_alignment", joined_signal,
    f"WITH {SQL_EVENT_BARS} {SQL_SIGNAL} SELECT symbol, ts, round(CASE WHEN bar_no % 3 <> 0 THEN signal ELSE 0 END, 6) AS signal FROM sig")


def mark_returns(s, d):
    """Both conventions side by side for holding one bar short."""
    b = over_blocks(event_bars(s, d), lambda f: {"p1": f.lead("close")}, back=0, ahead=1).where("p1 IS NOT NULL")
    return rounded(b.select("symbol", "ts", bt.mark_return(F.lit(-1), F.col("close"), F.col("p1")).alias("by_mark"),
                            (-(F.col("p1") / F.col("close") - 1)).alias("by_bar")))


add("short_returns", mark_returns,
    f"WITH {SQL_EVENT_BARS}, q AS (SELECT *, lead(close) {W} AS p1 FROM bars) SELECT symbol, ts, round(close / p1 - 1, 6) AS by_mark, "
    "round(-(p1 / close - 1), 6) AS by_bar FROM q WHERE p1 IS NOT NULL")
