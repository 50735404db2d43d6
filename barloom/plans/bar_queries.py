"""Queries on bars: building, cleaning, trimming, indicators and conditions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import bars as ops
from barloom.operators import conditions as cond
from barloom.operators import indicators as ind
from barloom.plans.inputs import (
    SQL_EVENT_BARS,
    SQL_SHIP_BARS,
    brand_bars,
    event_bars,
    line_order,
    rounded,
    ship_bars,
    sql_select,
    table,
)
from barloom.session import durable

QUERIES, ORACLES = {}, {}
OHLCV = "open high low close volume"


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def on_events(fn, names, plain="symbol ts"):
    cols = [*plain.split(), *names.split()]
    return lambda s, d: rounded(fn(event_bars(s, d)).select(*cols))


def on_ships(fn, names, plain="symbol ts"):
    cols = [*plain.split(), *names.split()]
    return lambda s, d: rounded(fn(ship_bars(s, d)).select(*cols))


def sql(ctes, body, names, plain="symbol ts"):
    return f"WITH RECURSIVE {ctes} SELECT {sql_select(names, plain=plain)} FROM {body}"


def derive(name, cols, src="bars"):
    """A CTE that adds columns over w = the symbol's bars in order."""
    return f", {name} AS (SELECT *, {cols} FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY bar_no))"


def full(agg, n, need=None):
    fr = f"OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def go(x):
        return f"CASE WHEN count({x}) {fr} >= {need or n} THEN {agg}({x}) {fr} END"

    return go


# ---- bars --------------------------------------------------------------------------------
add("ohlcv_bars", on_events(lambda b: b, OHLCV, "symbol ts bar_no"), sql(SQL_EVENT_BARS, "bars", OHLCV, "symbol ts bar_no"))
add("ohlcv_bars_daily", on_ships(lambda b: b, OHLCV, "symbol ts bar_no"), sql(SQL_SHIP_BARS, "bars", OHLCV, "symbol ts bar_no"))
add(
    "brand_weekly_bars",
    lambda s, d: rounded(brand_bars(s, d, numbered=False).select("symbol", "ts", *OHLCV.split())),
    "SELECT symbol, ts, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, "
    "round(volume,6) AS volume FROM (SELECT p_brand AS symbol, date_trunc('week', l_shipdate)::TIMESTAMP AS ts, "
    "arg_min(l_extendedprice + 1000000.0, (l_orderkey, l_linenumber, l_extendedprice)) AS open, max(l_extendedprice + 1000000.0) AS high, "
    "min(l_extendedprice + 1000000.0) AS low, arg_max(l_extendedprice + 1000000.0, (l_orderkey, l_linenumber, l_extendedprice)) AS close, "
    "sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
)


def clean(s, d):
    """Prices as landed text with gaps; rows without a full bar go."""
    raw = ship_bars(s, d, numbered=False)
    landed = raw.select(
        "symbol", "ts", F.col("open").cast("string").alias("open"), "high", "low",
        F.when(F.col("volume") % 7 == 0, "n/a").otherwise(F.col("close").cast("string")).alias("close"), "volume",
    )
    return rounded(ops.clean_ohlc(landed).select("symbol", "ts", "bar_no", *OHLCV.split()))


add(
    "clean_ohlc",
    clean,
    f"WITH {SQL_SHIP_BARS}, k AS (SELECT * FROM bars WHERE volume % 7 <> 0) SELECT symbol, ts, "
    "row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no, round(open,6) AS open, round(high,6) AS high, "
    "round(low,6) AS low, round(close,6) AS close, round(volume,6) AS volume FROM k "
    "WHERE symbol IN (SELECT symbol FROM k GROUP BY 1 HAVING count(*) >= 3)",
)
add(
    "dedupe_last",
    lambda s, d: rounded(
        ops.keep_last(
            table(s, d, "lineitem").select(
                F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts"),
                F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber",
                line_order().alias("ingest_seq"),
            )
        ).select("symbol", "ts", "price", "l_orderkey", "l_linenumber")
    ),
    "SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, round(l_extendedprice,6) AS price, l_orderkey, "
    "l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag || l_linestatus, l_shipdate "
    "ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1",
)
add(
    "period_trim",
    lambda s, d: rounded(
        ops.trim_period(event_bars(s, d, numbered=False), "2wk", F.lit("2024-01-31 00:00:00"))
        .select("symbol", "ts", "close")
    ),
    f"WITH {SQL_EVENT_BARS} SELECT symbol, ts, round(close,6) AS close FROM bars WHERE ts >= TIMESTAMP '2024-01-17'",
)
add(
    "source_fallback",
    lambda s, d: ops.first_source_with_rows(
        table(s, d, "lineitem").select(
            F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("source"), "l_orderkey", "l_linenumber"
        ),
        {"R": 0, "A": 1, "N": 2},
    ).groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("n")),
    "WITH p AS (SELECT l_suppkey AS symbol, l_returnflag AS source, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 "
    "ELSE 2 END AS pr FROM lineitem) SELECT symbol, source, count(*) AS n FROM p WHERE pr = (SELECT min(pr) FROM p q "
    "WHERE q.symbol = p.symbol) GROUP BY 1, 2",
)


def wanted(s, d):
    flags = table(s, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("symbol"))
    made_up = table(s, d, "orders").select(F.concat("o_orderstatus", F.lit("-X")).alias("symbol"))
    return flags.union(made_up).distinct()


add(
    "run_manifest",
    lambda s, d: ops.manifest(ship_bars(s, d, numbered=False), wanted(s, d)),
    f"WITH {SQL_SHIP_BARS}, w AS (SELECT DISTINCT symbol FROM bars UNION SELECT o_orderstatus || '-X' FROM orders) "
    'SELECT w.symbol, count(b.ts) AS rows, CASE WHEN count(b.ts) > 0 THEN 6 ELSE 0 END AS "columns", min(b.ts) AS start, '
    'max(b.ts) AS "end", count(b.ts) = 0 AS failed FROM w LEFT JOIN bars b USING (symbol) GROUP BY 1',
)
add(
    "ordered_symbols",
    lambda s, d: ops.ordered_unique(
        table(s, d, "orders").select(F.concat("o_orderstatus", "o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("pos")),
        limit=10,
    ),
    "SELECT o_orderstatus || o_orderpriority AS symbol, min(o_orderkey) AS pos FROM orders GROUP BY 1 ORDER BY 2 LIMIT 10",
)


def live_columns(s, d):
    """Which features hold a value in the first 150 bars of each symbol."""
    f = ind.feature_matrix(event_bars(s, d))
    counts = f.where(F.col("bar_no") < 150).agg(*[F.count(c).alias(c) for c in ind.FEATURES])
    return counts.unpivot([], list(ind.FEATURES), "feature", "n_values").where(F.col("n_values") > 0)



# ---- window indicators ---------------------------------------------------------------------
RET = derive("r", "close - lag(close) OVER w AS diff_1, close / nullif(lag(close) OVER w,0) - 1 AS ret_1, "
             "close / nullif(lag(close,5) OVER w,0) - 1 AS ret_5, ln(close) - ln(lag(close) OVER w) AS log_ret_1, "
             "lag(close) OVER w AS pc")
add("returns", on_events(ind.returns, "diff_1 ret_1 ret_5 log_ret_1"), sql(SQL_EVENT_BARS + RET, "r", "diff_1 ret_1 ret_5 log_ret_1"))
add(
    "future_return",
    on_events(lambda b: ind.future_return(b, 5), "future_ret"),
    sql(SQL_EVENT_BARS + derive("r", "lead(close,5) OVER w / close - 1 AS future_ret"), "r", "future_ret"),
)
add(
    "labels",
    on_events(lambda b: ind.labels(b, 5, 0.002), "future_ret", "symbol ts label"),
    sql(
        SQL_EVENT_BARS + derive("r", "lead(close,5) OVER w / close - 1 AS future_ret")
        + ", l AS (SELECT *, CASE WHEN future_ret > 0.002 THEN 1 WHEN future_ret < -0.002 THEN -1 WHEN future_ret IS NOT NULL THEN 0 END AS label FROM r)",
        "l", "future_ret", "symbol ts label",
    ),
)
SMAS = (10, 20, 50, 100, 200)
add(
    "sma",
    on_ships(lambda b: ind.sma(b, SMAS), " ".join(f"sma_{p}" for p in SMAS)),
    sql(SQL_SHIP_BARS + derive("r", ", ".join(f"{full('avg', p)('close')} AS sma_{p}" for p in SMAS)), "r",
        " ".join(f"sma_{p}" for p in SMAS)),
)
add(
    "rolling_vol",
    on_events(ind.rolling_std, "vol_10 vol_20"),
    sql(SQL_EVENT_BARS + RET + derive("v", f"{full('stddev_pop', 10)('ret_1')} AS vol_10, {full('stddev_pop', 20)('ret_1')} AS vol_20", "r"),
        "v", "vol_10 vol_20"),
)
add(
    "realized_vol",
    on_events(ind.realized_vol, "rv"),
    sql(SQL_EVENT_BARS + RET + derive("v", f"{full('stddev_samp', 20, 10)('log_ret_1')} AS rv", "r"), "v", "rv"),
)
TR = RET + ", t AS (SELECT *, greatest(high - low, abs(high - coalesce(pc, high)), abs(low - coalesce(pc, low))) AS tr FROM r)"
add(
    "atr_simple",
    on_events(ind.atr_simple_prior, "tr atr_prev"),
    sql(SQL_EVENT_BARS + TR + derive("a", f"{full('avg', 14)('tr')} AS atr", "t") + derive("z", "lag(atr) OVER w AS atr_prev", "a"),
        "z", "tr atr_prev"),
)


def mid(n):
    return f"({full('max', n)('high')} + {full('min', n)('low')}) / 2"


ICHI = derive("i", f"{mid(9)} AS tenkan, {mid(26)} AS kijun, {mid(52)} AS sb, lead(close,26) OVER w AS chikou") + derive(
    "k", "lag((tenkan+kijun)/2,26) OVER w AS senkou_a, lag(sb,26) OVER w AS senkou_b", "i"
)
add("ichimoku", on_events(ind.ichimoku, "tenkan kijun senkou_a senkou_b chikou"),
    sql(SQL_EVENT_BARS + ICHI, "k", "tenkan kijun senkou_a senkou_b chikou"))
BB = derive("m", f"{full('avg', 20)('close')} AS bb_mid, {full('stddev_pop', 20)('close')} AS dev") + (
    ", bb AS (SELECT *, bb_mid + 2*dev AS bb_upper, bb_mid - 2*dev AS bb_lower, 4*dev / nullif(bb_mid,0) AS bb_width, "
    "(close - bb_mid + 2*dev) / nullif(4*dev,0) AS bb_pos FROM m)"
)
BBC = "bb_mid bb_upper bb_lower bb_width bb_pos"
add("bollinger", on_events(ind.bollinger, BBC), sql(SQL_EVENT_BARS + BB, "bb", BBC))
add(
    "volume_ratio",
    on_events(ind.volume_ratio, "volume_sma_20 volume_over_sma_20"),
    sql(SQL_EVENT_BARS + derive("v", f"{full('avg', 20)('volume')} AS volume_sma_20")
        + ", q AS (SELECT *, volume / nullif(volume_sma_20,0) - 1 AS volume_over_sma_20 FROM v)", "q", "volume_sma_20 volume_over_sma_20"),
)
CANDLE = (
    "high - low AS range, close - open AS body, abs(close - open) AS body_abs, high - greatest(open, close) AS upper_wick, "
    "least(open, close) - low AS lower_wick, abs(close - open) / nullif(high - low, 0) AS body_to_range"
)
CANDLES = "range body body_abs upper_wick lower_wick body_to_range"
add("candles", on_events(ind.candles, CANDLES), sql(SQL_EVENT_BARS + derive("c", CANDLE), "c", CANDLES))
add(
    "regime",
    lambda s, d: ind.regime(ship_bars(s, d)).select("symbol", "ts", "regime"),
    f"WITH {SQL_SHIP_BARS} {derive('m', f'''{full('avg', 50)('close')} AS s, {full('avg', 200)('close')} AS l''')} "
    "SELECT symbol, ts, CASE WHEN s IS NULL OR l IS NULL THEN 'neutral' WHEN s > l THEN 'bull' WHEN s < l THEN 'bear' END AS regime FROM m",
)
PIV = derive(
    "p",
    "lag(bar_no,5) OVER w IS NOT NULL AND lead(bar_no,5) OVER w IS NOT NULL AND high = max(high) OVER a AS pivot_high, "
    "lag(bar_no,5) OVER w IS NOT NULL AND lead(bar_no,5) OVER w IS NOT NULL AND low = min(low) OVER a AS pivot_low",
).replace(
    "ORDER BY bar_no))", "ORDER BY bar_no), a AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))"
)
add("pivots", lambda s, d: ind.pivots(event_bars(s, d)).select("symbol", "ts", "pivot_high", "pivot_low"),
    f"WITH {SQL_EVENT_BARS} {PIV} SELECT symbol, ts, pivot_high, pivot_low FROM p")
add("liquidity", on_events(ind.liquidity, "dollar_volume hl_range"),
    sql(SQL_EVENT_BARS + derive("q", "close * volume AS dollar_volume, (high - low) / nullif(close,0) AS hl_range"), "q", "dollar_volume hl_range"))
add(
    "support_resistance",
    lambda s, d: rounded(cond.support_resistance(event_bars(s, d), tolerance=0.003)),
    f"""WITH RECURSIVE {SQL_EVENT_BARS} {PIV},
    pts AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY level) AS i FROM (
      SELECT symbol, 'support' AS kind, low AS level FROM p WHERE pivot_low
      UNION ALL SELECT symbol, 'resistance', high FROM p WHERE pivot_high)),
    f AS (SELECT symbol, kind, i, level AS m, 1 AS g FROM pts WHERE i = 1
      UNION ALL SELECT f.symbol, f.kind, q.i,
        CASE WHEN abs(q.level - m) / greatest(1e-9, m) <= 0.003 THEN (m + q.level) / 2 ELSE q.level END,
        CASE WHEN abs(q.level - m) / greatest(1e-9, m) <= 0.003 THEN g ELSE g + 1 END
      FROM f JOIN pts q ON q.symbol = f.symbol AND q.kind = f.kind AND q.i = f.i + 1),
    lv AS (SELECT symbol, kind, g, arg_max(m, i) AS level FROM f GROUP BY 1, 2, 3),
    rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY CASE WHEN kind = 'support' THEN -level ELSE level END) AS level_no FROM lv)
    SELECT symbol, kind, level_no, round(level, 6) AS level FROM rk WHERE level_no <= 6""",
)
FIB = """,
 nb AS (SELECT *, max(bar_no) OVER (PARTITION BY symbol) + 1 AS n_bars FROM bars),
 sw AS (SELECT symbol, max(high) AS swing_high, min(low) AS swing_low, arg_max(close, bar_no) AS close FROM nb
   WHERE bar_no >= n_bars - 60 GROUP BY symbol),
 fb AS (SELECT *, unnest([0.236::DOUBLE, 0.382, 0.5, 0.618, 0.786]) AS r FROM sw),
 fd AS (SELECT *, swing_high - r * (swing_high - swing_low) AS lv, abs(close - (swing_high - r * (swing_high - swing_low))) / close AS dist FROM fb),
 fib AS (SELECT symbol, swing_high, swing_low, close, r AS nearest_ratio, lv AS nearest_level, dist, dist <= 0.01 AS fib_ok FROM fd
   QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dist, r) = 1)"""
FIBC = "swing_high swing_low close nearest_ratio nearest_level dist"
add("fibonacci", lambda s, d: rounded(cond.fibonacci(event_bars(s, d))),
    f"WITH {SQL_EVENT_BARS} {FIB} SELECT {sql_select(FIBC, plain='symbol fib_ok')} FROM fib")
SIG = ICHI + """,
 lastbar AS (SELECT *, CASE WHEN bar_no >= 79 AND tenkan IS NOT NULL AND kijun IS NOT NULL AND senkou_a IS NOT NULL AND senkou_b IS NOT NULL THEN
     CASE WHEN close > greatest(senkou_a, senkou_b) AND tenkan > kijun AND senkou_a >= senkou_b THEN 'long'
          WHEN close < least(senkou_a, senkou_b) AND tenkan < kijun AND senkou_a <= senkou_b THEN 'short' END END AS direction
   FROM k QUALIFY bar_no = max(bar_no) OVER (PARTITION BY symbol))"""
add("ichimoku_signal", lambda s, d: rounded(cond.ichimoku_signal(event_bars(s, d))),
    f"WITH {SQL_EVENT_BARS} {SIG} SELECT {sql_select('close tenkan kijun senkou_a senkou_b', plain='symbol direction')}, "
    "direction IS NOT NULL AS ichimoku_ok FROM lastbar")


# ---- recursive means -------------------------------------------------------------------------
def sql_ewm(name, src, x, alpha, need):
    """Recursive CTE: exponentially weighted mean of a column that has values from some bar on."""
    return f""",
 {name}_in AS (SELECT symbol, bar_no, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY bar_no) AS i FROM {src} WHERE {x} IS NOT NULL),
 {name}_r AS (SELECT symbol, bar_no, i, x AS y FROM {name}_in WHERE i = 1
   UNION ALL SELECT p.symbol, n.bar_no, n.i, (1 - {alpha}) * p.y + {alpha} * n.x FROM {name}_r p JOIN {name}_in n ON n.symbol = p.symbol AND n.i = p.i + 1),
 {name} AS (SELECT symbol, bar_no, CASE WHEN i >= {need} THEN y END AS {name} FROM {name}_r)"""


def a_span(n):
    return f"(2.0::DOUBLE / {n + 1})"


WILDER = "(1.0::DOUBLE / 14)"
add(
    "ewm",
    on_events(lambda b: ind.ema(b, (12, 26)), "ema_12 ema_26"),
    sql(SQL_EVENT_BARS + sql_ewm("ema_12", "bars", "close", a_span(12), 12) + sql_ewm("ema_26", "bars", "close", a_span(26), 26),
        "bars LEFT JOIN ema_12 USING (symbol, bar_no) LEFT JOIN ema_26 USING (symbol, bar_no)", "ema_12 ema_26"),
)
GAIN = RET + ", gl AS (SELECT *, greatest(diff_1, 0) AS gain, greatest(-diff_1, 0) AS loss FROM r WHERE diff_1 IS NOT NULL)"
RSI = GAIN + sql_ewm("ag", "gl", "gain", WILDER, 14) + sql_ewm("al", "gl", "loss", WILDER, 14) + (
    ", rs AS (SELECT symbol, ts, bar_no, 100 - 100 / (1 + ag / nullif(al, 0)) AS rsi_14 FROM bars LEFT JOIN ag USING (symbol, bar_no) "
    "LEFT JOIN al USING (symbol, bar_no))"
)
add("rsi", on_events(ind.rsi, "rsi_14"), sql(SQL_EVENT_BARS + RSI, "rs", "rsi_14"))
ATR = TR + sql_ewm("atr_14", "t", "tr", WILDER, 14)
add("atr_wilder", on_events(ind.atr_wilder, "tr atr_14"),
    sql(SQL_EVENT_BARS + ATR, "t LEFT JOIN atr_14 USING (symbol, bar_no)", "tr atr_14"))
MACD = (
    sql_ewm("ema_12", "bars", "close", a_span(12), 12) + sql_ewm("ema_26", "bars", "close", a_span(26), 26)
    + ", mc AS (SELECT symbol, bar_no, ema_12, ema_26, ema_12 - ema_26 AS macd FROM ema_12 JOIN ema_26 USING (symbol, bar_no))"
    + sql_ewm("macd_signal", "mc", "macd", a_span(9), 9)
    + ", mq AS (SELECT symbol, bar_no, ema_12, ema_26, macd, macd_signal, macd - macd_signal AS macd_hist FROM mc LEFT JOIN macd_signal USING (symbol, bar_no))"
)
add("macd", on_events(ind.macd, "macd macd_signal macd_hist"),
    sql(SQL_EVENT_BARS + MACD, "bars LEFT JOIN mq USING (symbol, bar_no)", "macd macd_signal macd_hist"))
add(
    "trade_style",
    lambda s, d: rounded(cond.trade_style(event_bars(s, d), "1h")),
    f"WITH RECURSIVE {SQL_EVENT_BARS} {ATR} SELECT symbol, round(atr_14 / close, 6) AS atr_over_close, "
    "CASE WHEN atr_14 / close >= 0.015 THEN 'day' ELSE 'scalp' END AS style FROM bars JOIN atr_14 USING (symbol, bar_no) "
    "QUALIFY bar_no = max(bar_no) OVER (PARTITION BY symbol)",
)
FM = (
    RSI + MACD + ICHI + BB.replace("FROM bars", "FROM k")
    + derive("fw", ", ".join(f"{full('avg', p)('close')} AS sma_{p}" for p in SMAS) + f", {full('avg', 20)('volume')} AS volume_sma_20, "
             + CANDLE, "bb")
    + derive("fv", f"{full('stddev_pop', 10)('ret_1')} AS volatility_10, {full('stddev_pop', 20)('ret_1')} AS volatility_20", "r")
    + """, fm AS (SELECT fw.*, fv.ret_1 AS return_1, fv.ret_5 AS return_5, fv.log_ret_1 AS log_return_1, volatility_10, volatility_20,
       ema_12, ema_26, macd, macd_signal, macd_hist, rsi_14 AS rsi14, senkou_a AS senkoua, senkou_b AS senkoub,
       fw.volume / nullif(volume_sma_20, 0) - 1 AS volume_over_sma_20, """
    + ", ".join(f"fw.close / nullif(sma_{p},0) - 1 AS close_over_sma_{p}" for p in SMAS)
    + ", fw.close / nullif(ema_12,0) - 1 AS close_over_ema_12, fw.close / nullif(ema_26,0) - 1 AS close_over_ema_26 "
    + "FROM fw JOIN fv USING (symbol, bar_no) LEFT JOIN mq USING (symbol, bar_no) LEFT JOIN rs USING (symbol, bar_no))"
)
add("features", lambda s, d: rounded(ind.feature_matrix(event_bars(s, d)).drop("bar_no"), 5),
    f"WITH RECURSIVE {SQL_EVENT_BARS} {FM} SELECT "
    + sql_select(" ".join(ind.FEATURES), digits=5)
    + " FROM fm")
COND = SIG + RSI.replace(RET, "").replace(", gl AS", RET + ", gl AS", 1) + FIB + """,
 rl AS (SELECT symbol, arg_max(rsi_14, bar_no) AS rsi_14 FROM rs WHERE rsi_14 IS NOT NULL GROUP BY 1),
 cs AS (SELECT symbol, direction, direction IS NOT NULL AS ichimoku_ok, rsi_14,
   coalesce(CASE WHEN direction = 'long' THEN rsi_14 BETWEEN 50 AND 70 WHEN direction = 'short' THEN rsi_14 BETWEEN 30 AND 50
     ELSE rsi_14 BETWEEN 45 AND 55 END, false) AS rsi_ok, coalesce(fib_ok, false) AS fib_ok, nearest_ratio
   FROM lastbar LEFT JOIN rl USING (symbol) LEFT JOIN fib USING (symbol))"""


def rsi_by_direction(bars):
    return cond.rsi_condition(bars, cond.ichimoku_signal(bars))


add("rsi_condition",
    lambda s, d: rounded(rsi_by_direction(durable(event_bars(s, d)))),
    f"WITH RECURSIVE {SQL_EVENT_BARS} {COND} SELECT symbol, round(rsi_14,6) AS rsi_14, rsi_ok FROM cs")
SCORE = COND + ", sc AS (SELECT *, ichimoku_ok::INT + rsi_ok::INT + fib_ok::INT AS conditions_met FROM cs)"
add("condition_scores",
    lambda s, d: rounded(cond.condition_scores(durable(event_bars(s, d))).drop("news_ok", "news_items")),
    f"WITH RECURSIVE {SQL_EVENT_BARS} {SCORE} SELECT symbol, direction, ichimoku_ok, round(rsi_14,6) AS rsi_14, rsi_ok, fib_ok, "
    "nearest_ratio, conditions_met, conditions_met / 4.0::DOUBLE AS score FROM sc")


def chart_select(s, d):
    bars = durable(event_bars(s, d))
    scored = cond.condition_scores(bars)
    first_seen = bars.groupBy("symbol").agg(F.min("ts").alias("_t"))
    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_t", "symbol"))
    scored = scored.join(first_seen.select("symbol", pos.alias("pos")), "symbol")
    return cond.select_charts(scored, min_conditions=1, max_selected=3).select("symbol", "conditions_met", "score", "pos")


add("chart_select", chart_select,
    f"WITH RECURSIVE {SQL_EVENT_BARS} {SCORE}, po AS (SELECT symbol, row_number() OVER (ORDER BY min(ts), symbol) AS pos FROM bars GROUP BY symbol) "
    "SELECT symbol, conditions_met, conditions_met / 4.0::DOUBLE AS score, pos FROM sc JOIN po USING (symbol) WHERE conditions_met >= 1 "
    "ORDER BY conditions_met DESC, score DESC, pos LIMIT 3")


def left_out(s, d):
    scored = cond.condition_scores(durable(event_bars(s, d))).withColumn("pos", F.col("symbol"))
    return cond.not_selected(scored, cond.select_charts(scored, min_conditions=1, max_selected=3))


add("charts_left_out", left_out,
    f"WITH RECURSIVE {SQL_EVENT_BARS} {SCORE} SELECT symbol FROM sc WHERE symbol NOT IN (SELECT symbol FROM sc WHERE conditions_met >= 1 "
    "ORDER BY conditions_met DESC, symbol LIMIT 3)")

add("live_feature_columns", live_columns,
    f"WITH RECURSIVE {SQL_EVENT_BARS} {FM}, c AS (SELECT " + ", ".join(f"count({c}) AS {c}" for c in ind.FEATURES)
    + " FROM fm WHERE bar_no < 150) SELECT * FROM (UNPIVOT c ON COLUMNS(*) INTO NAME feature VALUE n_values) WHERE n_values > 0")
