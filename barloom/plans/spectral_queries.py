"""Queries on cycles, gates, autoregression, tensors and dynamic modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cycles as cy
from barloom.operators import indicators as ind
from barloom.operators import tensor as tn
from barloom.operators.layout import number_rows
from barloom.plans import market
from barloom.plans.inputs import HOUR, SQL_EVENT_BARS, WEEK, brand_bars, event_bars, rounded, spread, table
from barloom.plans.panel_queries import panel_returns
from barloom.session import durable

QUERIES, ORACLES = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


W = "OVER (PARTITION BY symbol ORDER BY bar_no)"
add("detrend", lambda s, d: rounded(cy.detrended(event_bars(s, d), "close", pos="bar_no").select("symbol", "ts", "detrended")),
    f"WITH {SQL_EVENT_BARS}, f AS (SELECT symbol, regr_slope(close, bar_no) AS a, regr_intercept(close, bar_no) AS b FROM bars GROUP BY 1) "
    "SELECT symbol, ts, round(close - (a * bar_no + b), 6) AS detrended FROM bars JOIN f USING (symbol)")
add("dominant_cycles", lambda s, d: rounded(cy.dominant_cycles(event_bars(s, d)), 5),
    f"""WITH {SQL_EVENT_BARS},
    tl AS (SELECT symbol, bar_no - min(bar_no) OVER (PARTITION BY symbol) AS t, close, count(*) OVER (PARTITION BY symbol) AS n FROM
      (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_no DESC) <= 256)),
    ft AS (SELECT symbol, regr_slope(close, t) AS a, regr_intercept(close, t) AS b FROM tl GROUP BY 1),
    x AS (SELECT symbol, t, n, (close - (a * t + b)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * t / (n - 1))) AS v FROM tl JOIN ft USING (symbol)),
    q AS (SELECT symbol, n, k AS f, sum(v * cos(2 * pi() * ((t * k) % n) / n)) AS re, -sum(v * sin(2 * pi() * ((t * k) % n) / n)) AS im
      FROM x, range(1, 129) r(k) WHERE k <= n // 2 AND n / k >= 5 GROUP BY 1, 2, 3),
    p AS (SELECT *, re * re + im * im AS power, row_number() OVER (PARTITION BY symbol ORDER BY re * re + im * im DESC) AS k FROM q)
    SELECT symbol, k, round(n / f, 5) AS period, round(f / n, 5) AS frequency, round(power, 5) AS power, round(2 * sqrt(power) / n, 5) AS amplitude,
      round(atan2(im, re), 5) AS phase FROM p WHERE k <= 3""")
CYCLE_COLS = "fft_period1 fft_power1 fft_amp1 fft_period2 fft_period3".split()
add("cycle_columns", lambda s, d: rounded(market.with_cycle_columns(event_bars(s, d)).select("symbol", "ts", "fft_period", *CYCLE_COLS), 5))
add("centred_returns", lambda s, d: rounded(cy.centred_returns(event_bars(s, d)).select("symbol", "ts", "x")),
    f"WITH {SQL_EVENT_BARS}, r AS (SELECT *, coalesce(ln(close) - ln(lag(close) {W}), 0) AS r FROM bars) "
    "SELECT symbol, ts, round(r - avg(r) OVER (PARTITION BY symbol), 6) AS x FROM r")
add("rolling_period", lambda s, d: rounded(cy.rolling_dominant_period(event_bars(s, d)).select("symbol", "ts", "period")))
SW = 32
add("rolling_period_32", lambda s, d: rounded(cy.rolling_dominant_period(event_bars(s, d), window=SW).select("symbol", "ts", "period")),
    f"""WITH {SQL_EVENT_BARS},
    wn AS (SELECT e.symbol, e.bar_no AS e, b.bar_no - (e.bar_no - {SW - 1}) AS t, b.close FROM bars e JOIN bars b ON b.symbol = e.symbol
      AND b.bar_no BETWEEN e.bar_no - {SW - 1} AND e.bar_no WHERE e.bar_no >= {SW - 1}),
    ft AS (SELECT symbol, e, regr_slope(close, t) AS a, regr_intercept(close, t) AS b FROM wn GROUP BY 1, 2),
    x AS (SELECT symbol, e, t, (close - (a * t + b)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * t / {SW - 1})) AS v FROM wn JOIN ft USING (symbol, e)),
    q AS (SELECT symbol, e, k, sum(v * cos(2 * pi() * ((t * k) % {SW}) / {SW})) ** 2 + sum(v * sin(2 * pi() * ((t * k) % {SW}) / {SW})) ** 2 AS pw
      FROM x, range(1, 7) r(k) GROUP BY 1, 2, 3),
    m AS (SELECT symbol, e, {SW}.0::DOUBLE / arg_max(k, pw) AS period FROM q GROUP BY 1, 2)
    SELECT b.symbol, b.ts, round(period, 6) AS period FROM bars b LEFT JOIN m ON m.symbol = b.symbol AND m.e = b.bar_no""")


def flags(df):
    return df.select("symbol", "ts", "ok")


add("fft_gate", lambda s, d: flags(cy.fft_gate(event_bars(s, d))))
add("dwt_gate", lambda s, d: flags(cy.dwt_gate(cy.centred_returns(event_bars(s, d)))))
for kernel in ("dwt_db2", "dwt_db8", "cwt_morlet", "cwt_ricker", "unknown"):
    add(f"kernel_gate_{kernel}", lambda s, d, k=kernel: flags(cy.kernel_gate(cy.centred_returns(event_bars(s, d)), k)))
ORACLES["kernel_gate_unknown"] = f"WITH {SQL_EVENT_BARS} SELECT symbol, ts, false AS ok FROM bars"


def log_rets(s, d):
    return ind.returns(event_bars(s, d)).select("symbol", "ts", "bar_no", F.col("log_ret_1").alias("ret"))


add("dmd_gate", lambda s, d: flags(cy.dmd_gate(log_rets(s, d))))
LAGS = f""",
 lr AS (SELECT symbol, ts, bar_no, coalesce(ln(close) - ln(lag(close) {W}), 0) AS r FROM bars),
 lg AS (SELECT *, lag(r) {W} AS r1, lag(r, 2) {W} AS r2 FROM lr)"""
add("ar_sums", lambda s, d: rounded(cy.ar_sums(log_rets(s, d), p=2, train=F.col("bar_no") < 450)),
    f"WITH {SQL_EVENT_BARS} {LAGS} SELECT symbol, count(*) AS n, round(sum(r*r1),6) AS s0_1, round(sum(r*r2),6) AS s0_2, round(sum(r1*r1),6) AS s1_1, "
    "round(sum(r1*r2),6) AS s1_2, round(sum(r2*r2),6) AS s2_2 FROM lg WHERE bar_no >= 2 AND bar_no < 450 GROUP BY 1")


def residuals(s, d):
    r = durable(log_rets(s, d))
    return rounded(cy.ar_residuals(r, cy.ar_coefficients(r, p=2, train=F.col("bar_no") < 450), p=2).select("symbol", "ts", "resid"))


SQL_AR = LAGS + """,
 sm AS (SELECT symbol, sum(r*r1) AS b1, sum(r*r2) AS b2, sum(r1*r1) + 1e-6 AS a, sum(r1*r2) AS c, sum(r2*r2) + 1e-6 AS e FROM lg WHERE bar_no >= 2 AND bar_no < 450 GROUP BY 1),
 be AS (SELECT symbol, (e*b1 - c*b2) / (a*e - c*c) AS k1, (a*b2 - c*b1) / (a*e - c*c) AS k2 FROM sm)"""
add("ar_residuals", residuals,
    f"WITH {SQL_EVENT_BARS} {SQL_AR} SELECT symbol, ts, round(CASE WHEN bar_no < 2 THEN 0 ELSE r - (k1 * r1 + k2 * r2) END, 6) AS resid FROM lg JOIN be USING (symbol)")


def forecast(s, d, fn):
    f = fn(event_bars(s, d))
    return rounded(f.select("symbol", F.posexplode("forecast").alias("step", "value")))


add("naive_forecast", lambda s, d: forecast(s, d, lambda b: cy.naive_forecast(b, 3)),
    f"WITH {SQL_EVENT_BARS} SELECT symbol, unnest([0, 1, 2]) AS step, round(v, 6) AS value FROM (SELECT symbol, arg_max(close, bar_no) AS v FROM bars GROUP BY 1)")
add("ar_forecast", lambda s, d: forecast(s, d, lambda b: cy.ar_forecast(b, 3, p=2)),
    f"""WITH RECURSIVE {SQL_EVENT_BARS},
    lr AS (SELECT symbol, bar_no, close, coalesce(close - lag(close) {W}, 0) AS r FROM bars), lg AS (SELECT *, lag(r) {W} AS r1, lag(r, 2) {W} AS r2 FROM lr),
    sm AS (SELECT symbol, sum(r*r1) AS b1, sum(r*r2) AS b2, sum(r1*r1) + 1e-6 AS a, sum(r1*r2) AS c, sum(r2*r2) + 1e-6 AS e FROM lg WHERE bar_no >= 2 GROUP BY 1),
    be AS (SELECT symbol, (e*b1 - c*b2) / (a*e - c*c) AS k1, (a*b2 - c*b1) / (a*e - c*c) AS k2 FROM sm),
    fc AS (SELECT symbol, -1 AS step, close AS value, r AS d1, r1 AS d2, k1, k2 FROM lg JOIN be USING (symbol) QUALIFY bar_no = max(bar_no) OVER (PARTITION BY symbol)
      UNION ALL SELECT symbol, step + 1, value + k1 * d1 + k2 * d2, k1 * d1 + k2 * d2, d1, k1, k2 FROM fc WHERE step < 2)
    SELECT symbol, step, round(value, 6) AS value FROM fc WHERE step >= 0""")

# ---- tensor ---------------------------------------------------------------------------------
FEATS = ("returns", "rv", "depth", "dollar_volume", "hl_range")
SQL_TENSOR = f""",
 tr AS (SELECT *, ln(close) - ln(lag(close) {W}) AS returns, close * volume AS dollar_volume, (high - low) / nullif(close, 0) AS hl_range FROM bars),
 tv AS (SELECT *, CASE WHEN count(returns) OVER v >= 10 THEN stddev_samp(returns) OVER v END AS rv FROM tr WINDOW v AS (PARTITION BY symbol ORDER BY bar_no ROWS 19 PRECEDING)),
 lo AS (""" + " UNION ALL ".join(f"SELECT ts, symbol, '{f}' AS feature, {f} AS v FROM tv" for f in FEATS if f != "depth") + """),
 tz AS (SELECT ts, symbol, feature, coalesce((v - avg(v) OVER (PARTITION BY feature)) / stddev_pop(v) OVER (PARTITION BY feature), 0) AS z FROM lo)"""
add("tensor_long", lambda s, d: rounded(tn.tensor_long(event_bars(s, d), FEATS)),
    f"WITH {SQL_EVENT_BARS} {SQL_TENSOR} SELECT ts, symbol, feature, round(z, 6) AS z FROM tz")


def event_tensor(s, d):
    return durable(tn.tensor_long(event_bars(s, d), FEATS))


def two(table, key, x="x"):
    return rounded(table.select(key, F.get(x, F.lit(0)).alias("f1"), F.get(x, F.lit(1)).alias("f2")))


SWEEPS = 8


def sql_cp(sweeps=SWEEPS):
    """The alternating steps for two factors, written out: each step solves a 2 x 2 system of the other modes' products."""
    start = lambda key, r: f"(('0x' || substr(md5({key} || '/{r}'), 1, 8))::BIGINT)::DOUBLE / 4294967296 - 0.5"
    out, now = ["cells AS MATERIALIZED (SELECT * FROM tz WHERE z <> 0)"], {"symbol": "s0", "feature": "f0"}
    for key, name in now.items():
        out.append(f"{name} AS MATERIALIZED (SELECT {key}, {start(key, 0)} AS a, {start(key, 1)} AS b FROM (SELECT DISTINCT {key} FROM cells))")
    for k in range(1, sweeps + 1):
        for key in ("ts", "symbol", "feature"):
            x, y = [n for m, n in now.items() if m != key]
            on = [m for m in now if m != key]
            name = f"{key[0]}{k}"
            out.append(f"""m{name} AS MATERIALIZED (SELECT c.{key}, sum(z * x.a * y.a) AS p, sum(z * x.b * y.b) AS q FROM cells c JOIN {x} x ON x.{on[0]} = c.{on[0]} JOIN {y} y ON y.{on[1]} = c.{on[1]} GROUP BY 1),
 g{name} AS MATERIALIZED (SELECT xaa * yaa AS aa, xab * yab AS ab, xbb * ybb AS bb FROM (SELECT sum(a * a) AS xaa, sum(a * b) AS xab, sum(b * b) AS xbb FROM {x})
   CROSS JOIN (SELECT sum(a * a) AS yaa, sum(a * b) AS yab, sum(b * b) AS ybb FROM {y})),
 {name} AS MATERIALIZED (SELECT {key}, (p * bb - q * ab) / (aa * bb - ab * ab) AS a, (q * aa - p * ab) / (aa * bb - ab * ab) AS b FROM m{name} CROSS JOIN g{name})""")
            now[key] = name
    return ",\n ".join(out), now


SQL_CP, LAST = sql_cp()


def cp_fit(s, d):
    errors = tn.cp_decompose(event_tensor(s, d), 2, sweeps=SWEEPS).errors
    return rounded(s.createDataFrame([(SWEEPS, errors[-1])], "sweep int, error double"), 5)


add("cp_time_factor", lambda s, d: two(tn.cp_decompose(event_tensor(s, d), 2, sweeps=SWEEPS).time, "ts"),
    f"WITH {SQL_EVENT_BARS} {SQL_TENSOR}, {SQL_CP} SELECT ts, round(a, 6) AS f1, round(b, 6) AS f2 FROM {LAST['ts']}")
add("cp_asset_factor", lambda s, d: two(tn.cp_decompose(event_tensor(s, d), 2, sweeps=SWEEPS).asset, "symbol"),
    f"WITH {SQL_EVENT_BARS} {SQL_TENSOR}, {SQL_CP} SELECT symbol, round(a, 6) AS f1, round(b, 6) AS f2 FROM {LAST['symbol']}")
add("cp_fit", cp_fit,
    f"""WITH {SQL_EVENT_BARS} {SQL_TENSOR}, {SQL_CP} SELECT {SWEEPS} AS sweep, round(sqrt(sum((z - t.a * s.a * f.a - t.b * s.b * f.b) ^ 2 - (t.a * s.a * f.a + t.b * s.b * f.b) ^ 2) / sum(z * z)
      + (SELECT sum((t.a * s.a * f.a + t.b * s.b * f.b) ^ 2) FROM {LAST['ts']} t CROSS JOIN {LAST['symbol']} s CROSS JOIN {LAST['feature']} f) / sum(z * z)), 5) AS error
    FROM cells c JOIN {LAST['ts']} t ON t.ts = c.ts JOIN {LAST['symbol']} s ON s.symbol = c.symbol JOIN {LAST['feature']} f ON f.feature = c.feature""")
add("tucker_time_factor", lambda s, d: two(tn.tucker_decompose(event_tensor(s, d), (2, 2, 2))[0].time, "ts"))


def sql_power(key, steps=300):
    """The leading vector of the tensor unfolded along a mode, by repeated products."""
    return f""",
 cells AS MATERIALIZED (SELECT *, ts::VARCHAR || '/' || {'feature' if key == 'symbol' else 'symbol'} AS at FROM tz WHERE z <> 0),
 pairs AS MATERIALIZED (SELECT a.{key} AS u, b.{key} AS v, sum(a.z * b.z) AS g FROM cells a JOIN cells b ON a.at = b.at GROUP BY 1, 2),
 power AS (SELECT 0 AS it, v, 1.0::DOUBLE + ascii(right(v, 1)) / 100.0::DOUBLE AS x FROM (SELECT DISTINCT v FROM pairs)
   UNION ALL SELECT it + 1, v, y / sqrt(sum(y * y) OVER ()) FROM (SELECT p.it, g.u AS v, sum(p.x * g.g) AS y FROM power p JOIN pairs g ON g.v = p.v WHERE p.it < {steps} GROUP BY p.it, g.u)),
 lead AS (SELECT v AS {key}, x * (SELECT sign(arg_min(x, v)) FROM power WHERE it = {steps} AND abs(x) > 1e-9) AS f1 FROM power WHERE it = {steps})"""


for _key in ("symbol", "feature"):
    add(f"tucker_{_key}_factor",
        lambda s, d, k=_key: rounded(getattr(tn.tucker_decompose(event_tensor(s, d), (2, 2, 2))[0], {"symbol": "asset"}.get(k, k)).select(k, F.get("x", F.lit(0)).alias("f1"))),
        f"WITH RECURSIVE {SQL_EVENT_BARS} {SQL_TENSOR} {sql_power(_key)} SELECT {_key}, round(f1, 6) AS f1 FROM lead")


def brand_tensor(s, d):
    b = number_rows(brand_bars(s, d, numbered=False), step_seconds=WEEK)
    return durable(tn.tensor_long(b, ("returns", "rv")))


add("asset_embedding", lambda s, d: rounded(tn.embed_2d(tn.cp_decompose(brand_tensor(s, d), 2, sweeps=SWEEPS).asset)))
add("dynamic_modes", lambda s, d: rounded(tn.dynamic_modes(panel_returns(s, d), 3, step_seconds=WEEK)))


def parity_returns(s, d):
    """Two assets: the daily values of lines with an odd and an even quantity, on the days that have both."""
    li = spread(table(s, d, "lineitem"), "l_orderkey").groupBy(
        F.when(F.col("l_quantity").cast("long") % 2 == 0, "even").otherwise("odd").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts")
    ).agg(F.ln(F.sum("l_extendedprice")).alias("ret"))
    full = li.groupBy("ts").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")).where("n = 2")
    return durable(li.join(full, "ts").select("symbol", "ts", F.col("ret") - 10.0).toDF("symbol", "ts", "ret"))


add("dynamic_modes_pair",
    lambda s, d: rounded(tn.dynamic_modes(parity_returns(s, d), 2).select("eig_real", "eig_imag", "growth", "frequency")),
    """WITH v AS (SELECT CASE WHEN l_quantity::BIGINT % 2 = 0 THEN 'even' ELSE 'odd' END AS symbol, l_shipdate::TIMESTAMP AS ts, ln(sum(l_extendedprice)) - 10.0 AS x FROM lineitem GROUP BY 1, 2),
     w AS (SELECT ts, max(x) FILTER (symbol = 'even') AS x, max(x) FILTER (symbol = 'odd') AS y FROM v GROUP BY 1 HAVING count(*) = 2),
     n AS (SELECT x, y, lead(x) OVER (ORDER BY ts) AS p, lead(y) OVER (ORDER BY ts) AS q FROM w),
     m AS (SELECT sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy, sum(p*x) AS px, sum(p*y) AS py, sum(q*x) AS qx, sum(q*y) AS qy FROM n WHERE p IS NOT NULL),
     a AS (SELECT (px*yy - py*xy) / (xx*yy - xy*xy) AS a, (py*xx - px*xy) / (xx*yy - xy*xy) AS b, (qx*yy - qy*xy) / (xx*yy - xy*xy) AS c, (qy*xx - qx*xy) / (xx*yy - xy*xy) AS d FROM m),
     e AS (SELECT (a + d) / 2 AS h, (a + d) * (a + d) / 4 - (a*d - b*c) AS disc FROM a),
     z AS (SELECT h + k * sqrt(greatest(disc, 0)) AS r, k * sqrt(greatest(-disc, 0)) AS i FROM e CROSS JOIN (VALUES (1), (-1)) t(k))
    SELECT round(r, 6) AS eig_real, round(i, 6) AS eig_imag, round(ln(sqrt(r*r + i*i)), 6) AS growth, round(atan2(i, r) / (2 * pi()), 6) AS frequency FROM z""")
add("growth_frequency",
    lambda s, d: rounded(tn.growth_frequency(table(s, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1e5).alias("eig_real"), (F.col("o_custkey") % 7 - 3).cast("double").alias("eig_imag"))), 8),
    "SELECT o_orderkey, round(r, 8) AS eig_real, round(i, 8) AS eig_imag, round(ln(sqrt(r*r + i*i)), 8) AS growth, round(atan2(i, r) / (2 * pi()), 8) AS frequency "
    "FROM (SELECT o_orderkey, o_totalprice / 1e5 AS r, (o_custkey % 7 - 3)::DOUBLE AS i FROM orders)")
