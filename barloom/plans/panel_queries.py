"""Queries that align several series: macro joins, panels, pairs, graphs, allocation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import joins as jn
from barloom.operators import network as nw
from barloom.operators.bars import enough_overlap
from barloom.operators.layout import number_rows
from barloom.operators.metrics import top_mean
from barloom.operators.order_stats import average_ranks
from barloom.plans.inputs import (
    SQL_BRAND_BARS,
    SQL_ORDER_MACRO,
    SQL_SHIP_BARS,
    WEEK,
    brand_bars,
    order_macro,
    rounded,
    ship_bars,
    sql_select,
    table,
)
from barloom.session import durable

QUERIES, ORACLES = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


SERIES = {"1-URGENT": "m1", "2-HIGH": "m2", "3-MEDIUM": "m3", "4-NOT SPECIFIED": "m4", "5-LOW": "m5"}


def stamped(df):
    return df.withColumn("date", F.col("date").cast("timestamp_ntz"))


def wide_macro(s, d):
    w = jn.pivot_series(order_macro(s, d), list(SERIES))
    return w.select("date", *[F.col(f"`{k}`").alias(v) for k, v in SERIES.items()])


SQL_WIDE = SQL_ORDER_MACRO + ", wide AS (SELECT date, " + ", ".join(
    f"max(value) FILTER (series_id = '{k}') AS {v}" for k, v in SERIES.items()
) + " FROM macro GROUP BY 1)"
MS = " ".join(SERIES.values())
add("pivot_series", lambda s, d: stamped(rounded(wide_macro(s, d), 4)),
    f"WITH {SQL_WIDE} SELECT date::TIMESTAMP AS date, {sql_select(MS, plain='', digits=4)} FROM wide")
add("exact_ffill_join",
    lambda s, d: rounded(jn.exact_then_fill(ship_bars(s, d), wide_macro(s, d), list(SERIES.values())).select("symbol", "ts", *MS.split()), 4),
    f"WITH {SQL_SHIP_BARS}, {SQL_WIDE}, j AS (SELECT b.symbol, b.ts, "
    + ", ".join(f"last_value({m} IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS {m}" for m in MS.split())
    + f" FROM bars b LEFT JOIN wide w ON w.date = b.ts) SELECT {sql_select(MS, digits=4)} FROM j")
add("asof_macro",
    lambda s, d: rounded(jn.asof_join(ship_bars(s, d, numbered=False), wide_macro(s, d), list(SERIES.values())).select("symbol", "ts", *MS.split()), 4),
    f"WITH {SQL_SHIP_BARS}, {SQL_WIDE}, f AS (SELECT date, "
    + ", ".join(f"last_value({m} IGNORE NULLS) OVER (ORDER BY date) AS {m}" for m in MS.split())
    + f" FROM wide) SELECT {sql_select(MS, plain='b.symbol b.ts', digits=4)} FROM bars b ASOF LEFT JOIN f ON b.ts >= f.date")


def deduped_macro(s, d):
    o = table(s, d, "orders")
    both = o.select(
        F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("date"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("priority"),
    )
    return stamped(rounded(jn.first_series_wins(both)))


add("macro_first_wins", deduped_macro,
    "SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::TIMESTAMP AS date, round(arg_min(o_totalprice, o_orderkey), 6) AS value FROM orders GROUP BY 1, 2")

SQL_PANEL = """,
 pn AS (SELECT *, count(*) OVER (PARTITION BY ts) AS c, (SELECT count(DISTINCT symbol) FROM bars) AS n FROM bars),
 panel AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM pn WHERE c = n),
 rets AS (SELECT * FROM (SELECT symbol, ts, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar_no)) AS ret FROM panel) WHERE ret IS NOT NULL)"""
add("panel_inner", lambda s, d: rounded(jn.panel_inner(durable(brand_bars(s, d, numbered=False)))),
    f"WITH {SQL_BRAND_BARS} {SQL_PANEL} SELECT symbol, ts, round(close, 6) AS close FROM panel")
add("panel_outer", lambda s, d: rounded(jn.panel_outer(ship_bars(s, d, numbered=False).withColumn("bar_no", F.lit(0)))),
    f"""WITH {SQL_SHIP_BARS}, cal AS (SELECT DISTINCT ts FROM bars), sy AS (SELECT DISTINCT symbol FROM bars),
    g AS (SELECT sy.symbol, cal.ts, last_value(b.close IGNORE NULLS) OVER (PARTITION BY sy.symbol ORDER BY cal.ts) AS close
      FROM cal CROSS JOIN sy LEFT JOIN bars b ON b.symbol = sy.symbol AND b.ts = cal.ts)
    SELECT symbol, ts, round(close, 6) AS close FROM g WHERE ts >= (SELECT max(m) FROM (SELECT min(ts) AS m FROM bars GROUP BY symbol))""")


def panel_returns(s, d):
    panel = number_rows(jn.panel_inner(durable(brand_bars(s, d, numbered=False))), step_seconds=WEEK)
    return durable(nw.log_returns(panel))


add("enough_overlap", lambda s, d: rounded(enough_overlap(panel_returns(s, d))),
    f"WITH {SQL_BRAND_BARS} {SQL_PANEL} SELECT symbol, ts, round(ret, 6) AS ret FROM rets WHERE (SELECT count(DISTINCT ts) >= 80 AND count(DISTINCT symbol) >= 3 FROM rets)")
add("too_little_overlap", lambda s, d: rounded(enough_overlap(panel_returns(s, d), min_symbols=1000)),
    f"WITH {SQL_BRAND_BARS} {SQL_PANEL} SELECT symbol, ts, round(ret, 6) AS ret FROM rets WHERE (SELECT count(DISTINCT symbol) >= 1000 FROM rets)")
add("panel_log_returns", lambda s, d: rounded(panel_returns(s, d)), f"WITH {SQL_BRAND_BARS} {SQL_PANEL} SELECT symbol, ts, round(ret, 6) AS ret FROM rets")


def grouped_flags(s, d):
    return durable(ship_bars(s, d, numbered=False).select("symbol", "ts"))


def split(s, d):
    """The whole table in two: lines that were not returned, and all others."""
    flags = grouped_flags(s, d)
    return flags.where(F.col("symbol").startswith("N")), flags.where(~F.col("symbol").startswith("N"))


add("common_dates", lambda s, d: jn.joint_dates(*split(s, d)),
    f"WITH {SQL_SHIP_BARS} SELECT ts FROM bars WHERE symbol LIKE 'N%' INTERSECT SELECT ts FROM bars WHERE symbol NOT LIKE 'N%'")
add("all_dates", lambda s, d: jn.joint_dates(*split(s, d), "outer"),
    f"WITH {SQL_SHIP_BARS} SELECT ts FROM bars WHERE symbol LIKE 'N%' UNION SELECT ts FROM bars WHERE symbol NOT LIKE 'N%'")
add("common_symbols",
    lambda s, d: jn.common_symbols([
        table(s, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("symbol")),
        table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("symbol")),
        table(s, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_partkey").alias("symbol")),
    ]),
    "SELECT l_partkey AS symbol FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' "
    "INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
add("stack_feeds",
    lambda s, d: jn.stack_feeds([
        table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("priority")),
        table(s, d, "events").select(F.col("event_id").alias("id"), "ts", "event_type"),
    ]),
    "SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS priority, NULL::VARCHAR AS event_type FROM orders "
    "UNION ALL SELECT event_id, ts, NULL, event_type FROM events")
add("ticker_sources",
    lambda s, d: jn.with_sources(table(s, d, "documents").select(F.col("source").alias("ticker")).distinct(), ["yahoo", "coinbase", "kraken"]),
    "SELECT DISTINCT d.source AS ticker, x.source FROM documents d CROSS JOIN (VALUES ('yahoo'), ('coinbase'), ('kraken')) x(source)")

# ---- pairs and graphs ----------------------------------------------------------------------
SQL_CORR = """,
 cr AS (SELECT a.symbol AS src, b.symbol AS dst, count(*) AS n, CASE WHEN count(*) >= 2 THEN coalesce(corr(a.ret, b.ret), 0) ELSE 0 END AS corr
   FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2)"""
BASE = SQL_BRAND_BARS + SQL_PANEL
add("corr_pairs", lambda s, d: rounded(nw.correlation_pairs(panel_returns(s, d), step_seconds=WEEK)),
    f"WITH {BASE} {SQL_CORR} SELECT src, dst, n, round(corr, 6) AS corr, round((corr + 1) / 2, 6) AS sim FROM cr")
SQL_RANK = """,
 rk0 AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2.0::DOUBLE AS rank FROM rets)"""
add("average_rank", lambda s, d: rounded(average_ranks(panel_returns(s, d), ["symbol"], "ret").select("symbol", "ts", "rank")),
    f"WITH {BASE} {SQL_RANK} SELECT symbol, ts, round(rank, 6) AS rank FROM rk0")
add("spearman", lambda s, d: rounded(nw.correlation_pairs(panel_returns(s, d), method="spearman", use_abs=True, step_seconds=WEEK)),
    f"WITH {BASE} {SQL_RANK}, cr AS (SELECT a.symbol AS src, b.symbol AS dst, count(*) AS n, coalesce(corr(a.rank, b.rank), 0) AS corr "
    "FROM rk0 a JOIN rk0 b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2) "
    "SELECT src, dst, n, round(corr, 6) AS corr, round((abs(corr) + 1) / 2, 6) AS sim FROM cr")


def gapped_returns(s, d):
    """Returns of all brands on the weeks each of them has."""
    return durable(nw.log_returns(brand_bars(s, d)))


add("spearman_gaps", lambda s, d: rounded(nw.correlation_pairs(gapped_returns(s, d), method="spearman", step_seconds=WEEK)),
    f"""WITH {SQL_BRAND_BARS}, rets AS (SELECT * FROM (SELECT symbol, ts, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar_no)) AS ret FROM bars) WHERE ret IS NOT NULL),
    pr AS (SELECT a.symbol AS src, b.symbol AS dst, a.ret AS x, b.ret AS y FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol),
    rk AS (SELECT src, dst, rank() OVER (PARTITION BY src, dst ORDER BY x) + (count(*) OVER (PARTITION BY src, dst, x) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER (PARTITION BY src, dst ORDER BY y) + (count(*) OVER (PARTITION BY src, dst, y) - 1) / 2.0::DOUBLE AS ry FROM pr),
    cr AS (SELECT src, dst, count(*) AS n, CASE WHEN count(*) >= 2 THEN coalesce(corr(rx, ry), 0) ELSE 0 END AS corr FROM rk GROUP BY 1, 2)
    SELECT src, dst, n, round(corr, 6) AS corr, round((corr + 1) / 2, 6) AS sim FROM cr""")
SQL_KNN = SQL_CORR + """,
 di AS (SELECT src, dst, (corr + 1) / 2 AS sim FROM cr UNION ALL SELECT dst, src, (corr + 1) / 2 FROM cr),
 tk AS (SELECT * FROM di QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst DESC) <= 5),
 edges AS (SELECT src, dst, max(sim) AS w FROM (SELECT src, dst, sim FROM tk UNION ALL SELECT dst, src, sim FROM tk) GROUP BY 1, 2),
 deg AS (SELECT src, sum(w) AS deg FROM edges GROUP BY 1)"""


def brand_graph(s, d):
    return nw.knn_edges(nw.correlation_pairs(panel_returns(s, d), step_seconds=WEEK), 5)


add("knn_graph", lambda s, d: rounded(brand_graph(s, d)), f"WITH {BASE} {SQL_KNN} SELECT src, dst, round(w, 6) AS w FROM edges")
for name, norm in (("laplacian", True), ("laplacian_plain", False)):
    v = "-w / sqrt(a.deg * b.deg)" if norm else "-w"
    own = "1.0::DOUBLE" if norm else "deg"
    add(name, lambda s, d, norm=norm: rounded(nw.laplacian(durable(brand_graph(s, d)), normalised=norm)),
        f"WITH {BASE} {SQL_KNN} SELECT e.src, e.dst, round({v}, 6) AS value FROM edges e JOIN deg a ON a.src = e.src JOIN deg b ON b.src = e.dst "
        f"UNION ALL SELECT src, src, round({own}, 6) FROM deg")
SQL_PR = """,
 nodes AS (SELECT DISTINCT src AS v FROM edges),
 pr AS (SELECT 0 AS it, v, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS x FROM nodes
   UNION ALL SELECT p.it + 1, e.dst, 0.85::DOUBLE * sum(p.x * e.w / d.deg) + 0.15::DOUBLE / any_value((SELECT count(*) FROM nodes))
   FROM pr p JOIN edges e ON e.src = p.v JOIN deg d ON d.src = e.src WHERE p.it < 60 GROUP BY p.it, e.dst)"""


def graph_scores(s, d, kind):
    return rounded(nw.centrality(brand_graph(s, d), kind, by=None))


add("pagerank", lambda s, d: graph_scores(s, d, "pagerank"),
    f"WITH RECURSIVE {BASE} {SQL_KNN} {SQL_PR} SELECT v AS symbol, round(x, 6) AS score FROM pr WHERE it = 60")
SQL_EV = """,
 nodes AS (SELECT DISTINCT src AS v FROM edges),
 ev AS (SELECT 0 AS it, v, 1.0::DOUBLE AS x FROM nodes
   UNION ALL SELECT it + 1, v, x / sqrt(sum(x * x) OVER ()) FROM (
     SELECT p.it, e.dst AS v, sum(p.x * e.w) AS x FROM ev p JOIN edges e ON e.src = p.v WHERE p.it < 200 GROUP BY p.it, e.dst))"""
add("eigenvector_centrality", lambda s, d: graph_scores(s, d, "eigenvector"),
    f"WITH RECURSIVE {BASE} {SQL_KNN} {SQL_EV} SELECT v AS symbol, round(x, 6) AS score FROM ev WHERE it = 200")
SQL_BETWEEN = """,
 nodes AS (SELECT DISTINCT src AS v FROM edges),
 ways AS (SELECT 0 AS it, v AS s, v, 0.0::DOUBLE AS d FROM nodes
   UNION ALL SELECT it + 1, s, v, min(d) FROM (
     SELECT it, s, v, d FROM ways WHERE it < 25
     UNION ALL SELECT p.it, p.s, e.dst, p.d + e.w FROM ways p JOIN edges e ON e.src = p.v WHERE p.it < 25) GROUP BY it, s, v),
 far AS (SELECT s, v, min(d) AS d FROM ways GROUP BY 1, 2),
 tight AS (SELECT a.s, a.v AS u, b.v FROM far a JOIN edges e ON e.src = a.v JOIN far b ON b.s = a.s AND b.v = e.dst WHERE abs(a.d + e.w - b.d) <= 1e-12 * b.d),
 hops AS (SELECT 0 AS it, v AS s, v, 1.0::DOUBLE AS c FROM nodes
   UNION ALL SELECT h.it + 1, h.s, t.v, sum(h.c) FROM hops h JOIN tight t ON t.s = h.s AND t.u = h.v GROUP BY h.it, h.s, t.v),
 counts AS (SELECT s, v, sum(c) AS c FROM hops GROUP BY 1, 2),
 shares AS (SELECT t.s, t.u, t.v, a.c / b.c AS p FROM tight t JOIN counts a ON a.s = t.s AND a.v = t.u JOIN counts b ON b.s = t.s AND b.v = t.v),
 waves AS (SELECT 0 AS it, s, v, 1.0::DOUBLE AS x FROM counts
   UNION ALL SELECT w.it + 1, w.s, p.u, sum(p.p * w.x) FROM waves w JOIN shares p ON p.s = w.s AND p.v = w.v GROUP BY w.it, w.s, p.u)"""
add("betweenness", lambda s, d: graph_scores(s, d, "betweenness"),
    f"WITH RECURSIVE {BASE} {SQL_KNN} {SQL_BETWEEN} SELECT v AS symbol, round(coalesce(sum(x) FILTER (it > 0 AND s <> v), 0) / "
    "(((SELECT count(*) FROM nodes) - 1) * ((SELECT count(*) FROM nodes) - 2)), 6) AS score FROM waves GROUP BY v")
SQL_FIEDLER = """,
 total AS (SELECT sum(deg) AS t FROM deg),
 start AS (SELECT src AS v, sqrt(deg / (SELECT t FROM total)) AS z, hash(src) / 18446744073709551615.0::DOUBLE - 0.5 AS x FROM deg),
 turns AS (SELECT 0 AS it, v, z, x - z * sum(x * z) OVER () AS x FROM start
   UNION ALL SELECT it + 1, v, z, y / sqrt(sum(y * y) OVER ()) FROM (
     SELECT it, v, z, x - z * sum(x * z) OVER () AS y FROM (
       SELECT p.it, a.src AS v, any_value(q.z) AS z, any_value(q.x) + sum(p.x * e.w / sqrt(a.deg * b.deg)) AS x
       FROM turns p JOIN edges e ON e.dst = p.v JOIN deg a ON a.src = e.src JOIN deg b ON b.src = e.dst JOIN turns q ON q.v = e.src
       WHERE p.it < 1500 GROUP BY p.it, a.src))),
 last AS (SELECT v, x FROM turns WHERE it = 1500),
 fv AS (SELECT v AS symbol, x * (SELECT sign(arg_min(x, v)) FROM last WHERE abs(x) > 1e-9) AS fiedler FROM last),
 fval AS (SELECT 1 - sum(p.fiedler * e.w / sqrt(a.deg * b.deg) * q.fiedler) AS fiedler_value
   FROM edges e JOIN deg a ON a.src = e.src JOIN deg b ON b.src = e.dst JOIN fv p ON p.symbol = e.src JOIN fv q ON q.symbol = e.dst)"""
add("fiedler", lambda s, d: rounded(nw.fiedler_vectors(brand_graph(s, d))),
    f"WITH RECURSIVE {BASE} {SQL_KNN} {SQL_FIEDLER} SELECT symbol, round(fiedler, 6) AS fiedler, round(fiedler_value, 6) AS fiedler_value FROM fv CROSS JOIN fval")
add("spectral_clusters", lambda s, d: rounded(nw.spectral_clusters(panel_returns(s, d), k=5, step_seconds=WEEK)),
    f"WITH RECURSIVE {BASE} {SQL_KNN} {SQL_FIEDLER} SELECT symbol, round(fiedler, 6) AS fiedler, round(fiedler_value, 6) AS fiedler_value, "
    "(fiedler >= (SELECT median(fiedler) FROM fv))::INT AS cluster FROM fv CROSS JOIN fval")

# ---- rolling networks -----------------------------------------------------------------------
SQL_ROLL = """,
 tn AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t_no FROM (SELECT DISTINCT ts FROM rets)),
 rp AS (SELECT a.symbol AS a, b.symbol AS b, a.ts, t_no, corr(a.ret, b.ret) OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.ts ROWS 59 PRECEDING) AS c
   FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol JOIN tn ON tn.ts = a.ts),
 rd AS (SELECT ts, a AS src, b AS dst, (abs(coalesce(c, 0)) + 1) / 2 AS sim FROM rp WHERE t_no >= 59
   UNION ALL SELECT ts, b, a, (abs(coalesce(c, 0)) + 1) / 2 FROM rp WHERE t_no >= 59),
 rt AS (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY ts, src ORDER BY sim DESC, dst DESC) <= 8),
 redges AS (SELECT ts, src, dst, max(sim) AS w FROM (SELECT ts, src, dst, sim FROM rt UNION ALL SELECT ts, dst, src, sim FROM rt) GROUP BY 1, 2, 3)"""


def networks(s, d):
    return nw.rolling_networks(panel_returns(s, d), step_seconds=WEEK)


add("rolling_corr", lambda s, d: rounded(networks(s, d).select("ts", "src", "dst", "w")),
    f"WITH {BASE} {SQL_ROLL} SELECT ts, src, dst, round(w, 6) AS w FROM redges")


def rolling_rank(s, d, kind="pagerank"):
    e = durable(networks(s, d))
    stamps = e.select("t_no", "ts").distinct()
    return nw.centrality(e, kind).join(stamps, "t_no").select("ts", "symbol", "score")


SQL_ROLL_PR = SQL_ROLL + """,
 rdeg AS (SELECT ts, src, sum(w) AS deg FROM redges GROUP BY 1, 2),
 rtr AS (SELECT e.ts, e.src, e.dst, e.w / d.deg AS p, count(*) OVER (PARTITION BY e.ts, e.dst) AS k FROM redges e JOIN rdeg d ON d.ts = e.ts AND d.src = e.src),
 rn AS (SELECT ts, count(*) AS n FROM rdeg GROUP BY 1),
 rpr AS (SELECT 0 AS it, d.ts, d.src AS v, 1.0::DOUBLE / n AS x, n FROM rdeg d JOIN rn USING (ts)
   UNION ALL SELECT q.it + 1, t.ts, t.dst, 0.85::DOUBLE * sum(q.x * t.p) + 0.15::DOUBLE / any_value(q.n), any_value(q.n)
   FROM rpr q JOIN rtr t ON t.ts = q.ts AND t.src = q.v WHERE q.it < 40 GROUP BY q.it, t.ts, t.dst),
 rscore AS (SELECT ts, v AS symbol, x AS score FROM rpr WHERE it = 40)"""
add("rolling_pagerank", lambda s, d: rounded(rolling_rank(s, d), 5),
    f"WITH RECURSIVE {BASE} {SQL_ROLL_PR} SELECT ts, symbol, round(score, 5) AS score FROM rscore")
SQL_ROLL_EV = SQL_ROLL + """,
 rev AS (SELECT 0 AS it, ts, v, 1.0::DOUBLE AS x FROM (SELECT DISTINCT ts, src AS v FROM redges)
   UNION ALL SELECT it + 1, ts, v, y / sqrt(sum(y * y) OVER (PARTITION BY ts)) FROM (
     SELECT p.it, e.ts, e.dst AS v, sum(p.x * e.w) AS y FROM rev p JOIN redges e ON e.ts = p.ts AND e.src = p.v WHERE p.it < 60 GROUP BY p.it, e.ts, e.dst))"""
add("rolling_eigenvector", lambda s, d: rounded(rolling_rank(s, d, "eigenvector"), 5),
    f"WITH RECURSIVE {BASE} {SQL_ROLL_EV} SELECT ts, v AS symbol, round(x, 5) AS score FROM rev WHERE it = 60")
add("rolling_betweenness", lambda s, d: rounded(rolling_rank(s, d, "betweenness")))
add("systemic_index", lambda s, d: rounded(top_mean(rolling_rank(s, d), out="systemic_index"), 5),
    f"WITH RECURSIVE {BASE} {SQL_ROLL_PR} SELECT ts, round(avg(score), 5) AS systemic_index FROM "
    "(SELECT * FROM rscore QUALIFY row_number() OVER (PARTITION BY ts ORDER BY score DESC) <= 5) GROUP BY ts")

# ---- allocation ---------------------------------------------------------------------------
def given_clusters(s, d):
    """Clusters by the brand number, so that the SQL can state them."""
    return table(s, d, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn(
        "cluster", (F.regexp_extract("symbol", r"(\d+)", 1).cast("int") % 3)
    )


SQL_ALLOC = """,
 lastn AS (SELECT DISTINCT ts FROM rets ORDER BY ts DESC LIMIT 60),
 cl AS (SELECT DISTINCT p_brand AS symbol, regexp_extract(p_brand, '(\\d+)', 1)::INT % 3 AS cluster FROM part),
 av AS (SELECT symbol, cluster, stddev_samp(ret) AS vol FROM rets JOIN cl USING (symbol) WHERE ts IN (SELECT ts FROM lastn) GROUP BY 1, 2),
 cret AS (SELECT ts, cluster, avg(ret) AS ret FROM rets JOIN cl USING (symbol) GROUP BY 1, 2),
 cv AS (SELECT cluster, 1 / (nullif(stddev_samp(ret), 0) + 1e-12) AS cw FROM cret WHERE ts IN (SELECT ts FROM lastn) GROUP BY 1),
 w0 AS (SELECT symbol, cluster, vol, (1 / (nullif(vol, 0) + 1e-12)) / sum(1 / (nullif(vol, 0) + 1e-12)) OVER (PARTITION BY cluster)
   * cw / (SELECT sum(cw) FROM cv) AS raw FROM av JOIN cv USING (cluster)),
 w1 AS (SELECT *, least(greatest(raw, 0.01), 0.06) AS b FROM w0), w2 AS (SELECT *, b / sum(b) OVER () AS weight FROM w1),
 alloc AS (SELECT *, weight * weight * vol * vol / (sum(weight * weight * vol * vol) OVER () + 1e-12) AS risk_contrib_diag FROM w2)"""
add("allocation",
    lambda s, d: rounded(nw.allocate(panel_returns(s, d), given_clusters(s, d), min_weight=0.01, max_weight=0.06)),
    f"WITH {BASE} {SQL_ALLOC} SELECT symbol, cluster, round(weight, 6) AS weight, round(vol, 6) AS vol, round(risk_contrib_diag, 6) AS risk_contrib_diag FROM alloc")
add("trailing_volatility", lambda s, d: rounded(nw.trailing_volatility(panel_returns(s, d), "symbol")),
    f"WITH {BASE} {SQL_ALLOC} SELECT symbol, round(vol, 6) AS vol FROM av")
add("cluster_returns", lambda s, d: rounded(nw.cluster_returns(panel_returns(s, d), given_clusters(s, d))),
    f"WITH {BASE} {SQL_ALLOC} SELECT ts, cluster, round(ret, 6) AS ret FROM cret")


def sorted_weights(s, d):
    a = nw.allocate(panel_returns(s, d), given_clusters(s, d))
    w = Window.partitionBy("cluster").orderBy(F.desc("weight"))
    return rounded(a.select("symbol", "cluster", "weight").withColumn("place", F.row_number().over(w)).orderBy("cluster", F.desc("weight")))


add("weights_sorted", sorted_weights,
    f"WITH {BASE} {SQL_ALLOC} SELECT symbol, cluster, round(raw, 6) AS weight, row_number() OVER (PARTITION BY cluster ORDER BY raw DESC) AS place FROM w0")
