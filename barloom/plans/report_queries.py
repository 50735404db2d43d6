"""Queries on run comparison, the strategy sweep and the market summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.symbols import display_metric
from barloom.operators import indicators as ind
from barloom.operators import metrics as mx
from barloom.operators import report as rp
from barloom.operators import sweep as sw
from barloom.plans import market
from barloom.plans.backtest_queries import SQL_METRICS, curve_of, sql_curve
from barloom.plans.bar_queries import ATR, ICHI, RSI, full
from barloom.plans.inputs import SQL_EVENT_BARS, event_bars, rounded, spread, sql_select, table
from barloom.sources import runs as rn
from barloom.plans.strategy import SQL_SIGNAL
from barloom.session import durable

QUERIES, ORACLES = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


ASSETS = ("BTC-USD", "eth-usd", "EURUSD=X", "AAPL", "SOL", "MSFT")
MODELS = ("HistGradientBoosting", "rf", "nn", "xgb")
KERNELS = (None, "dwt_db8", "cwt_morlet", "my kernel!")


def pick(values, n):
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def run_texts(s, d):
    """One run summary per order as JSON text; the order's numbers choose the configuration."""
    o = spread(table(s, d, "orders"), "o_orderkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    single = k % 4 != 0
    price = F.col("o_totalprice") / 1e5
    m = F.struct((price - 2).alias("sharpe"), (price / 10).alias("total_return"), (-price / 20).alias("max_drawdown"), (k % 500).alias("n_bars"))
    cfg = F.struct(
        F.when(single, pick(ASSETS, c)).alias("asset"), pick(MODELS, k).alias("model"),
        pick(("long_short", "Long-Only", "long"), c).alias("mode"), pick(("predict", "proba"), k).alias("signal_source"),
        F.when(k % 3 == 0, F.lit(0.01)).when(k % 3 == 1, F.lit(0.0)).alias("stop_loss"), F.when(k % 5 == 0, F.lit(0.02)).alias("take_profit"),
        F.when(c % 4 == 0, F.lit(0.1)).alias("vol_target"), (k % 2 == 0).alias("uses_hmm"), (c % 3 == 0).alias("uses_wavelet"),
        pick(KERNELS, c).alias("wavelet_kernel"), F.when(k % 6 == 0, F.lit(5)).alias("wavelet_ar_p"),
        F.when(single, m).alias("metrics"), F.when(~single, m).alias("portfolio_metrics"),
        F.when(k % 5 != 0, F.struct((k % 90).alias("n_trades"), ((c % 11) / 10.0).alias("win_rate"), F.lit("NaN").alias("profit_factor"))).alias("trade_metrics"),
    )
    # a bare NaN literal, as Python's writer leaves it
    return o.select(F.concat(F.lit("bt_"), k.cast("string")).alias("run"), F.replace(F.to_json(cfg), F.lit('"NaN"'), F.lit("NaN")).alias("value"))


def run_assets(s, d):
    """Assets of the portfolio runs: two customers' picks each."""
    o = table(s, d, "orders").where("o_orderkey % 4 = 0")
    two = F.array(pick(ASSETS, F.col("o_custkey")), pick(ASSETS, F.col("o_custkey") + 1 + F.col("o_orderkey") % 5))
    return o.select(F.concat(F.lit("bt_"), F.col("o_orderkey").cast("string")).alias("run"), F.col("o_orderkey"), F.col("o_totalprice"), F.explode(two).alias("asset"))


def runs(s, d):
    return rn.parse_summaries(run_texts(s, d))


SQL_RUNS = """runs AS (SELECT 'bt_' || o_orderkey AS run, o_orderkey AS k, o_custkey AS c, o_orderkey % 4 = 0 AS is_portfolio,
   CASE WHEN o_orderkey % 4 <> 0 THEN ['BTC-USD','eth-usd','EURUSD=X','AAPL','SOL','MSFT'][o_custkey % 6 + 1] END AS asset,
   ['hgb','rf','mlp','xgb'][o_orderkey % 4 + 1] AS short_model, o_totalprice / 1e5 - 2 AS m_sharpe, o_totalprice / 1e5 / 10 AS m_total_return,
   -(o_totalprice / 1e5) / 20 AS m_max_drawdown, o_orderkey % 500 AS m_n_bars,
   o_custkey % 3 <> 0 AS long_only, o_orderkey % 2 = 1 AS uses_proba_signal, o_orderkey % 3 = 0 AS uses_stop_loss, o_orderkey % 5 = 0 AS uses_take_profit,
   false AS uses_trailing_stop, false AS uses_trailing_atr, o_custkey % 4 = 0 AS uses_vol_target, o_orderkey % 2 = 0 AS uses_hmm, false AS uses_fft,
   o_custkey % 3 = 0 AS uses_wavelet, false AS uses_dmd, o_orderkey % 4 = 2 AS uses_neural_net,
   ['wavelet','wv_db8','wv_morlet','wv_my_kernel'][o_custkey % 4 + 1] || CASE WHEN o_orderkey % 6 = 0 THEN '_ar5' ELSE '' END AS wl,
   CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 90 END AS t_n_trades, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 11) / 10 END AS t_win_rate FROM orders),
 combo AS (SELECT *, concat_ws('+', short_model, CASE WHEN long_only THEN 'long_only' END, CASE WHEN uses_proba_signal THEN 'proba' END, CASE WHEN uses_hmm THEN 'hmm' END,
   CASE WHEN uses_wavelet THEN wl END, CASE WHEN uses_neural_net THEN 'nn' END, CASE WHEN uses_stop_loss THEN 'stop' END, CASE WHEN uses_take_profit THEN 'tp' END,
   CASE WHEN uses_vol_target THEN 'vol_target' END) AS feature_combo FROM runs),
 ra AS (SELECT 'bt_' || o_orderkey AS run, o_totalprice, o_orderkey, unnest([['BTC-USD','eth-usd','EURUSD=X','AAPL','SOL','MSFT'][o_custkey % 6 + 1],
   ['BTC-USD','eth-usd','EURUSD=X','AAPL','SOL','MSFT'][(o_custkey + 1 + o_orderkey % 5) % 6 + 1]]) AS asset FROM orders WHERE o_orderkey % 4 = 0)"""
FLAGS = ", ".join(rp.FLAGS)
add("component_flags", lambda s, d: rp.component_flags(runs(s, d)).select("run", *rp.FLAGS), f"WITH {SQL_RUNS} SELECT run, {FLAGS} FROM runs")
add("combo_label", lambda s, d: rp.combo_label(rp.component_flags(runs(s, d))).select("run", "feature_combo"), f"WITH {SQL_RUNS} SELECT run, feature_combo FROM combo")
RM = ["m_sharpe", "m_total_return", "m_max_drawdown", "t_win_rate"]
add("run_report", lambda s, d: rounded(rp.report_rows(runs(s, d)).select("run", "is_portfolio", "asset", "feature_combo", "m_n_bars", "t_n_trades", *RM), 10),
    f"WITH {SQL_RUNS} SELECT {sql_select(' '.join(RM), plain='run is_portfolio asset feature_combo m_n_bars t_n_trades', digits=10)} FROM combo")


def rollup(s, d):
    """Portfolio runs without trade metrics take those of their assets."""
    a = run_assets(s, d).select("run", (F.col("o_orderkey") % 7).alias("n_trades"), (F.col("o_totalprice") / 1e6).alias("win_rate"), F.lit(float("inf")).alias("profit_factor"))
    r = rp.report_rows(runs(s, d), asset_trades=a)
    return rounded(r.where("is_portfolio").select("run", "t_n_trades", "t_win_rate", "t_profit_factor"), 8)


add("portfolio_trade_rollup", rollup,
    f"WITH {SQL_RUNS}, g AS (SELECT run, sum(o_orderkey % 7)::BIGINT AS n, CASE WHEN max(o_orderkey % 7) > 0 THEN avg(o_totalprice / 1e6) END AS w FROM ra GROUP BY 1) "
    "SELECT run, coalesce(t_n_trades, CASE WHEN k % 5 = 0 THEN n END) AS t_n_trades, round(coalesce(t_win_rate, w), 8) AS t_win_rate, "
    "CASE WHEN k % 5 <> 0 THEN 'nan'::DOUBLE END AS t_profit_factor FROM runs JOIN g USING (run)")
add("exclude_crypto",
    lambda s, d: rp.exclude_crypto(runs(s, d).withColumn("is_portfolio", F.col("portfolio_metrics").isNotNull()), run_assets(s, d)).select("run", "is_portfolio", "asset"),
    f"WITH {SQL_RUNS}, p AS (SELECT run, bool_and(upper(asset) IN ('BTC-USD', 'ETH-USD', 'SOL')) AS al FROM ra GROUP BY 1) "
    "SELECT run, is_portfolio, asset FROM runs LEFT JOIN p USING (run) WHERE NOT CASE WHEN is_portfolio THEN coalesce(al, false) ELSE upper(asset) IN ('BTC-USD', 'ETH-USD', 'SOL') END")


def per_asset(s, d):
    a = run_assets(s, d).select("run", "asset", (F.col("o_totalprice") / 1e5 - 3).alias("m_sharpe"))
    return rp.asset_rows(rp.report_rows(runs(s, d)).select("run", "is_portfolio", "asset", "m_sharpe", "m_n_bars"), a)


SQL_ASSET = SQL_RUNS + ", ar AS (SELECT run, asset, m_sharpe, m_n_bars FROM runs WHERE NOT is_portfolio UNION ALL SELECT run, asset, o_totalprice / 1e5 - 3, NULL FROM ra)"
add("asset_rows", lambda s, d: rounded(per_asset(s, d), 8), f"WITH {SQL_ASSET} SELECT run, asset, round(m_sharpe, 8) AS m_sharpe, m_n_bars FROM ar")
add("best_per_asset", lambda s, d: rounded(rp.best_per_asset(per_asset(s, d)), 8),
    f"WITH {SQL_ASSET} SELECT asset, run, round(m_sharpe, 8) AS m_sharpe FROM ar QUALIFY row_number() OVER (PARTITION BY asset ORDER BY m_sharpe DESC, run) = 1")


def merged(s, d):
    a = per_asset(s, d).withColumn("pos", F.coalesce("m_n_bars", F.lit(0)) + F.length("asset"))
    return rounded(rp.merge_asset(rp.report_rows(runs(s, d)).select("run", "feature_combo", "m_sharpe", "asset"), a, "AAPL").select("run", "feature_combo", "asset", "m_sharpe"), 8)


add("merge_asset", merged,
    f"WITH {SQL_ASSET} SELECT DISTINCT run, feature_combo, ar.asset, round(ar.m_sharpe, 8) AS m_sharpe FROM combo JOIN ar USING (run) WHERE ar.asset = 'AAPL'")
add("ranked_runs", lambda s, d: rounded(rp.ranked_runs(rp.report_rows(runs(s, d)), drop_flat=True).select("run", "m_sharpe"), 8),
    f"WITH {SQL_RUNS} SELECT run, round(m_sharpe, 8) AS m_sharpe FROM runs WHERE abs(m_sharpe) > 1e-12")
add("component_matrix", lambda s, d: rp.component_matrix(rp.component_flags(runs(s, d))),
    f"WITH {SQL_RUNS} SELECT run, " + ", ".join(f"{f}::INT::DOUBLE AS {f}" for f in rp.FLAGS) + " FROM runs")
add("risk_return", lambda s, d: rounded(rp.risk_return(rp.report_rows(runs(s, d))), 10),
    f"WITH {SQL_RUNS} SELECT run, round(m_max_drawdown, 10) AS m_max_drawdown, round(m_total_return, 10) AS m_total_return FROM runs")
add("metric_names", lambda s, d: run_texts(s, d).select("run", display_metric(F.when(F.length("run") % 2 == 0, "m_sharpe").otherwise("m_other")).alias("label")),
    "SELECT 'bt_' || o_orderkey AS run, CASE WHEN length('bt_' || o_orderkey) % 2 = 0 THEN 'Sharpe ratio (annualized)' ELSE 'm_other' END AS label FROM orders")

# ---- sweep -------------------------------------------------------------------------------------
W = "OVER (PARTITION BY symbol ORDER BY bar_no)"


def core_signals(s, d):
    """Signals of three cores and simple gates, all from the last returns."""
    b = ind.returns(event_bars(s, d))
    r, r5 = F.coalesce("ret_1", F.lit(0.0)), F.coalesce("ret_5", F.lit(0.0))
    sign = lambda x: F.when(x > 0.01, 1.0).when(x < -0.01, -1.0).otherwise(0.0)
    cores = F.array(
        F.struct(F.lit("hgb").alias("core"), sign(r).alias("signal")), F.struct(F.lit("rf").alias("core"), sign(r5).alias("signal")),
        F.struct(F.lit("mlp").alias("core"), sign(r + r5).alias("signal")),
    )
    kernels = F.create_map(F.lit("dwt_db2"), r > 0, F.lit("dwt_db8"), r5 > 0, F.lit("dwt_db8_ar5"), r5 < 0, F.lit("cwt_morlet"), r < 0)
    return b.select(
        "symbol", "ts", F.inline(cores), sign(2 * r).alias("proba_signal"), (F.abs(r) < 0.05).alias("fft_ok"), (r5 > -0.03).alias("dmd_ok"),
        (F.abs(r) > 0.08).alias("risk_off"), kernels.alias("wavelet_by_kernel"),
    )


def gated(s, d):
    g = sw.gated_signals(core_signals(s, d), sw.variant_grid(s))
    return g.groupBy("symbol", "name").agg(F.sum("signal").alias("net"), F.count_if(F.col("signal") != 0).alias("n_open"), F.count(F.lit(1)).alias("n"))


def sql_variants():
    rows = []
    for core in sw.CORES:
        for o in sw.options():
            cells = [f"'{core}_{o[0]}'", f"'{core}'", *[str(x).lower() for x in (o[1], *o[3:7])], f"'{o[11]}'" if o[11] else "NULL", str(o[12] or "NULL")]
            rows.append("(" + ", ".join(cells) + ")")
    return "vr(name, core, use_proba, hmm, fft, wav, dmd, kernel, arp) AS (VALUES " + ", ".join(rows) + ")"


add("gated_signals", gated,
    f"""WITH {SQL_EVENT_BARS}, {sql_variants()},
    rt AS (SELECT symbol, ts, coalesce(close / lag(close) {W} - 1, 0) AS r, coalesce(close / lag(close, 5) {W} - 1, 0) AS r5 FROM bars),
    vs AS (SELECT symbol, name, CASE WHEN use_proba THEN sign(CASE WHEN abs(2*r) > 0.01 THEN r ELSE 0 END)
        ELSE CASE core WHEN 'hgb' THEN CASE WHEN abs(r) > 0.01 THEN sign(r) ELSE 0 END WHEN 'rf' THEN CASE WHEN abs(r5) > 0.01 THEN sign(r5) ELSE 0 END
             ELSE CASE WHEN abs(r + r5) > 0.01 THEN sign(r + r5) ELSE 0 END END END AS raw,
      (NOT fft OR abs(r) < 0.05) AND (NOT dmd OR r5 > -0.03) AND (NOT hmm OR NOT abs(r) > 0.08) AND (NOT wav OR
        coalesce(CASE coalesce(kernel, 'dwt_db8') || CASE WHEN arp IS NULL THEN '' ELSE '_ar5' END WHEN 'dwt_db2' THEN r > 0 WHEN 'dwt_db8' THEN r5 > 0
          WHEN 'dwt_db8_ar5' THEN r5 < 0 WHEN 'cwt_morlet' THEN r < 0 END, false)) AS pass FROM rt CROSS JOIN vr)
    SELECT symbol, name, sum(CASE WHEN pass THEN raw ELSE 0 END)::DOUBLE AS net, count(*) FILTER (pass AND raw <> 0) AS n_open, count(*) AS n FROM vs GROUP BY 1, 2""")
add("variant_plan", lambda s, d: event_bars(s, d, numbered=False).select("symbol").distinct().join(F.broadcast(sw.variant_grid(s))).select("symbol", "name", "core"),
    f"WITH {SQL_EVENT_BARS}, {sql_variants()} SELECT DISTINCT symbol, name, core FROM bars CROSS JOIN vr")

# ---- market summary ---------------------------------------------------------------------------
add("market_summary", lambda s, d: rounded(market.summary(durable(event_bars(s, d)), interval="1h").select("symbol", "ts", "last_close", "regime", "style")),
    f"WITH RECURSIVE {SQL_EVENT_BARS} {ATR}, m AS (SELECT *, {full('avg', 50)('close')} AS s50, {full('avg', 200)('close')} AS s200 FROM bars) "
    "SELECT symbol, ts, round(close, 6) AS last_close, CASE WHEN s50 IS NULL OR s200 IS NULL THEN 'neutral' WHEN s50 > s200 THEN 'bull' WHEN s50 < s200 THEN 'bear' END AS regime, "
    "CASE WHEN atr_14 / close >= 0.015 THEN 'day' ELSE 'scalp' END AS style FROM m JOIN atr_14 USING (symbol, bar_no) QUALIFY bar_no = max(bar_no) OVER (PARTITION BY symbol)")
add("market_enriched", lambda s, d: rounded(market.enriched(event_bars(s, d)).select("symbol", "ts", "rsi_14", "tenkan", "kijun", "senkou_a", "senkou_b")),
    f"WITH RECURSIVE {SQL_EVENT_BARS} {RSI} {ICHI} SELECT {sql_select('rsi_14 tenkan kijun senkou_a senkou_b', plain='symbol k.ts')} FROM k LEFT JOIN rs USING (symbol, bar_no)")


def recomputed(s, d):
    """Curve metrics of runs whose curves are at hand."""
    c = curve_of(s, d).withColumnRenamed("symbol", "run")
    return rounded(mx.curve_metrics(c.withColumn("symbol", F.col("run")), key=("run",)).select("run", "n_bars", "sharpe"))


add("recomputed_metrics", recomputed,
    f"WITH RECURSIVE {SQL_EVENT_BARS} {SQL_SIGNAL} {sql_curve()} {SQL_METRICS} SELECT symbol AS run, n_bars, round(sharpe, 6) AS sharpe FROM met")
