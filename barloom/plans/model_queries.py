"""Queries on labels, splits, imputation, model metrics and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import metrics as mx
from barloom.operators import models as md
from barloom.operators import splits as sp
from barloom.operators.bars import usable_rows
from barloom.operators.joins import align_columns
from barloom.operators.layout import over_blocks
from barloom.operators.regimes import mixture_states, risk_off
from barloom.plans.inputs import HOUR, SQL_EVENT_BARS, event_bars, rounded, sql_select
from barloom.session import durable

QUERIES, ORACLES = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


W = "OVER (PARTITION BY symbol ORDER BY bar_no)"
THR = 0.02


def labelled(s, d):
    b = ind.labels(event_bars(s, d), 3, THR)
    return sp.number_labelled(b, "label", step_seconds=HOUR)


SQL_LAB = f""",
 fu AS (SELECT *, lead(close, 3) {W} / close - 1 AS future_ret FROM bars),
 la AS (SELECT *, CASE WHEN future_ret > {THR} THEN 1 WHEN future_ret < -{THR} THEN -1 WHEN future_ret IS NOT NULL THEN 0 END AS label FROM fu),
 lb AS (SELECT *, row_number() {W} - 1 AS row_no, count(*) OVER (PARTITION BY symbol) AS n_rows FROM la WHERE label IS NOT NULL)"""
add("labelled_rows", lambda s, d: labelled(s, d).select("symbol", "ts", "label", "row_no", "n_rows"),
    f"WITH {SQL_EVENT_BARS} {SQL_LAB} SELECT symbol, ts, label, row_no, n_rows FROM lb")
add("holdout_split", lambda s, d: sp.holdout(labelled(s, d), 0.25).select("symbol", "ts", "row_no", "role"),
    f"WITH {SQL_EVENT_BARS} {SQL_LAB} SELECT symbol, ts, row_no, CASE WHEN row_no < greatest(30, least(floor(n_rows * 0.75), n_rows - 10)) "
    "THEN 'train' ELSE 'test' END AS role FROM lb WHERE n_rows >= 80")
SQL_FOLDS = SQL_LAB + """,
 sz AS (SELECT DISTINCT symbol, n_rows FROM lb WHERE n_rows >= 120 AND n_rows - 20 > 60),
 st AS (SELECT DISTINCT symbol, n_rows, floor(CASE WHEN i = 4 THEN n_rows - 20.0::DOUBLE ELSE i * ((n_rows - 20 - 60.0::DOUBLE) / 4) + 60.0::DOUBLE END)::BIGINT AS s
   FROM sz, range(5) r(i)),
 fo AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY s) AS fold, s - 5 AS train_end, s AS test_start, least(n_rows, s + 20) AS test_end
   FROM st WHERE s - 5 >= 60 AND least(n_rows, s + 20) - s >= 5),
 fk AS (SELECT fo.* FROM fo WHERE fold <= (SELECT min(m) FROM (SELECT max(fold) AS m FROM fo GROUP BY symbol))),
 wf AS (SELECT lb.symbol, lb.ts, lb.row_no, fold, CASE WHEN row_no < train_end THEN 'train' ELSE 'test' END AS role
   FROM lb JOIN fk ON fk.symbol = lb.symbol AND (row_no < train_end OR (row_no >= test_start AND row_no < test_end)))"""


def folds(s, d):
    return sp.walk_forward(labelled(s, d))


add("walkforward_folds", lambda s, d: folds(s, d).select("symbol", "ts", "row_no", "fold", "role"),
    f"WITH {SQL_EVENT_BARS} {SQL_FOLDS} SELECT symbol, ts, row_no, fold, role FROM wf")
add("fold_table", lambda s, d: sp.fold_table(labelled(s, d).select("symbol", "n_rows").distinct()),
    f"WITH {SQL_EVENT_BARS} {SQL_FOLDS} SELECT symbol, fold, train_end, test_start, test_end FROM fo")
add("fold_rollup", lambda s, d: sp.fold_rollup(folds(s, d)),
    f"WITH {SQL_EVENT_BARS} {SQL_FOLDS}, p AS (SELECT fold, symbol, max(ts) FILTER (role = 'train') AS a, min(ts) FILTER (role = 'test') AS b, "
    "max(ts) FILTER (role = 'test') AS c FROM wf GROUP BY 1, 2) SELECT fold, min(a) AS train_end_min, max(a) AS train_end_max, min(b) AS test_start_min, "
    "max(b) AS test_start_max, min(c) AS test_end_min, max(c) AS test_end_max FROM p GROUP BY 1")
add("sweep_split", lambda s, d: sp.sweep_split(labelled(s, d), purge=3).where("role IS NOT NULL").select("symbol", "row_no", "role"),
    f"WITH {SQL_EVENT_BARS} {SQL_LAB}, c AS (SELECT *, least(n_rows - 10, greatest(30, floor(n_rows * 0.65))) AS cut FROM lb) "
    "SELECT symbol, row_no, CASE WHEN row_no >= cut THEN 'test' ELSE 'train' END AS role FROM c WHERE row_no < cut - 3 OR row_no >= cut")
add("final_fit_rows", lambda s, d: sp.final_fit(labelled(s, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")),
    f"WITH {SQL_EVENT_BARS} {SQL_LAB} SELECT symbol, count(*) AS n, max(ts) AS last_ts FROM lb WHERE row_no < n_rows - 5 GROUP BY 1")
KINDS = ("click", "error", "purchase", "signup", "view")


def hot(s, d):
    b = event_bars(s, d, numbered=False)
    names = sorted(r["symbol"] for r in b.select("symbol").distinct().collect())
    return sp.one_hot(b, names).select("symbol", "ts", *[f"asset_{n}" for n in names])


add("asset_one_hot", hot,
    f"WITH {SQL_EVENT_BARS} SELECT symbol, ts, " + ", ".join(f"(symbol = '{k}')::INT AS asset_{k}" for k in KINDS) + " FROM bars")
SMALL = ["return_1", "return_5", "volatility_10", "sma_50", "rsi14"]


def small_features(s, d):
    b = event_bars(s, d)
    f = over_blocks(
        b,
        lambda f: {"return_1": ind.pct_change(f, "close"), "return_5": ind.pct_change(f, "close", 5), "sma_50": f.full(F.avg, F.col("close"), 50)},
        back=50,
    )
    return f.select("symbol", "ts", "bar_no", "close", "return_1", "return_5", "sma_50")


SQL_SMALL = """,
 sf AS (SELECT *, close / lag(close) OVER w - 1 AS return_1, close / lag(close, 5) OVER w - 1 AS return_5,
   CASE WHEN count(close) OVER v >= 50 THEN avg(close) OVER v END AS sma_50 FROM bars
   WINDOW w AS (PARTITION BY symbol ORDER BY bar_no), v AS (PARTITION BY symbol ORDER BY bar_no ROWS 49 PRECEDING))"""
COLS = ["return_1", "return_5", "sma_50"]
add("train_medians", lambda s, d: rounded(sp.train_medians(durable(small_features(s, d)), COLS, F.col("bar_no") < 400)),
    f"WITH {SQL_EVENT_BARS} {SQL_SMALL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}), 6) AS median FROM sf WHERE bar_no < 400" for c in COLS))
add("impute_median", lambda s, d: rounded(sp.impute(durable(small_features(s, d)), COLS, F.col("bar_no") < 400).select("symbol", "ts", *COLS)),
    f"WITH {SQL_EVENT_BARS} {SQL_SMALL} SELECT symbol, ts, " + ", ".join(
        f"round(coalesce({c}, (SELECT median({c}) FROM sf WHERE bar_no < 400)), 6) AS {c}" for c in COLS) + " FROM sf")
add("usable_rows",
    lambda s, d: usable_rows(small_features(s, d).withColumn("label", F.when(F.col("bar_no") % 4 != 0, F.col("bar_no"))), "label", COLS).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {SQL_EVENT_BARS} {SQL_SMALL} SELECT symbol, count(*) AS n FROM sf WHERE bar_no % 4 <> 0 AND coalesce(return_1, return_5, sma_50) IS NOT NULL GROUP BY 1")
add("model_columns", lambda s, d: rounded(align_columns(small_features(s, d), ["sma_50", "rsi14", "return_1"])),
    f"WITH {SQL_EVENT_BARS} {SQL_SMALL} SELECT symbol, ts, round(sma_50, 6) AS sma_50, 0.0::DOUBLE AS rsi14, round(return_1, 6) AS return_1 FROM sf")

# ---- metrics on a simple rule's predictions ----------------------------------------------------


def ruled(s, d):
    """The opposite of the last move as the predicted class."""
    f = over_blocks(labelled(s, d), lambda f: {"_r": ind.pct_change(f, "close")}, back=1, pos="row_no")
    return f.withColumn("prediction", F.when(F.col("_r") > THR, -1).when(F.col("_r") < -THR, 1).otherwise(0))


SQL_RULE = SQL_LAB + f""",
 ru AS (SELECT *, CASE WHEN r > {THR} THEN -1 WHEN r < -{THR} THEN 1 ELSE 0 END AS prediction FROM
   (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY row_no) - 1 AS r FROM lb)),
 cls AS (SELECT unnest([-1, 0, 1]) AS c), sym AS (SELECT DISTINCT symbol FROM lb),
 cf AS (SELECT k.symbol, a.c AS actual, p.c AS predicted, count(ru.symbol) AS n FROM sym k CROSS JOIN cls a CROSS JOIN cls p
   LEFT JOIN ru ON ru.symbol = k.symbol AND label = a.c AND prediction = p.c GROUP BY 1, 2, 3),
 rep AS (SELECT k.symbol, cls.c AS class, sum(n) FILTER (actual = cls.c AND predicted = cls.c) AS tp, sum(n) FILTER (actual = cls.c) AS support,
   sum(n) FILTER (predicted = cls.c) AS called FROM sym k CROSS JOIN cls JOIN cf ON cf.symbol = k.symbol GROUP BY 1, 2),
 rp AS (SELECT *, coalesce(tp / nullif(called, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM rep),
 rf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rp)"""
add("confusion", lambda s, d: mx.confusion(ruled(s, d), key=("symbol",)), f"WITH {SQL_EVENT_BARS} {SQL_RULE} SELECT symbol, actual, predicted, n FROM cf")
add("class_report", lambda s, d: rounded(mx.class_report(mx.confusion(ruled(s, d), key=("symbol",)), key=("symbol",)).drop("called", "tp")),
    f"WITH {SQL_EVENT_BARS} {SQL_RULE} SELECT {sql_select('precision recall f1', plain='symbol class')}, support::BIGINT AS support FROM rf")
add("classification_metrics", lambda s, d: rounded(mx.classification_metrics(ruled(s, d), key=("symbol",))),
    f"WITH {SQL_EVENT_BARS} {SQL_RULE} SELECT symbol, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, "
    "round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(f1) FILTER (support > 0 OR called > 0), 6) AS f1_macro FROM rf GROUP BY 1")
add("regression_metrics",
    lambda s, d: rounded(mx.regression_metrics(ruled(s, d).withColumn("prediction", F.col("prediction") * 0.1), "future_ret", key=("symbol",))),
    f"WITH {SQL_EVENT_BARS} {SQL_RULE} SELECT symbol, round(avg(abs(future_ret - prediction * 0.1)), 6) AS mae, round(sqrt(avg((future_ret - prediction * 0.1) ** 2)), 6) AS rmse, "
    "round(1 - sum((future_ret - prediction * 0.1) ** 2) / (var_pop(future_ret) * count(*)), 6) AS r2 FROM ru GROUP BY 1")
add("class_signals", lambda s, d: rounded(md.predicted_signal(ruled(s, d).withColumn("prediction", F.col("prediction") + 1)).select("symbol", "ts", "signal")),
    f"WITH {SQL_EVENT_BARS} {SQL_RULE} SELECT symbol, ts, prediction::DOUBLE AS signal FROM ru")
add("regression_signals",
    lambda s, d: md.predicted_signal(ruled(s, d).withColumn("p", F.col("future_ret") / 2), task="regression", threshold=0.01, prediction="p").select("symbol", "ts", "signal"),
    f"WITH {SQL_EVENT_BARS} {SQL_LAB} SELECT symbol, ts, CASE WHEN future_ret / 2 > 0.01 THEN 1.0::DOUBLE WHEN future_ret / 2 < -0.01 THEN -1.0 ELSE 0.0 END AS signal FROM lb")


def proba(s, d):
    x = labelled(s, d)
    up, down = 1 / (1 + F.exp(-30 * F.col("future_ret"))), 1 / (1 + F.exp(24 * F.col("future_ret")))
    return x.select("symbol", "ts", md.probability_signal(up, down, enter=0.55).alias("signal"),
                    md.probability_signal(up, down, enter=0.55, allow_short=False).alias("long_only"))


add("probability_signals", proba,
    f"WITH {SQL_EVENT_BARS} {SQL_LAB} SELECT symbol, ts, CASE WHEN 1 / (1 + exp(24 * future_ret)) >= 0.55 THEN -1.0::DOUBLE WHEN 1 / (1 + exp(-30 * future_ret)) >= 0.55 "
    "THEN 1.0 ELSE 0.0 END AS signal, CASE WHEN 1 / (1 + exp(-30 * future_ret)) >= 0.55 THEN 1.0::DOUBLE ELSE 0.0 END AS long_only FROM lb")


def states(s, d):
    """Three states by the last return's size."""
    b = ind.returns(event_bars(s, d)).select("symbol", "ts", "bar_no", F.col("ret_1").alias("ret"))
    r = F.coalesce(F.abs("ret"), F.lit(0.0))
    return b.withColumn("state", F.when(r < 0.02, 0).when(r < 0.05, 1).otherwise(2))


add("risk_off_gate", lambda s, d: risk_off(states(s, d), train=F.col("bar_no") < 400).select("symbol", "ts", "state", "risk_off"),
    f"""WITH {SQL_EVENT_BARS}, r AS (SELECT *, close / lag(close) {W} - 1 AS ret FROM bars),
    q AS (SELECT *, CASE WHEN coalesce(abs(ret), 0) < 0.02 THEN 0 WHEN coalesce(abs(ret), 0) < 0.05 THEN 1 ELSE 2 END AS state FROM r),
    w AS (SELECT symbol, state FROM (SELECT symbol, state, avg(coalesce(ret, 0)) AS m, stddev_samp(coalesce(ret, 0)) AS sd, count(*) AS n FROM q WHERE bar_no < 400 GROUP BY 1, 2)
      WHERE n >= 10 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sd DESC, m) = 1)
    SELECT q.symbol, q.ts, q.state, coalesce(q.state = w.state, false) AS risk_off FROM q LEFT JOIN w ON w.symbol = q.symbol""")
add("mixture_states", lambda s, d: mixture_states(
    ind.returns(event_bars(s, d)).select("symbol", "ts", "bar_no", F.col("log_ret_1").alias("ret")), train=F.col("bar_no") < 400
).select("symbol", "ts", "state"))

# ---- fitted models (checked by properties, not by SQL) ---------------------------------------
FEATS = ["return_1", "return_5", "log_return_1", "body_to_range", "volatility_10", "close_over_sma_20", "rsi14", "macd_hist", "bb_pos", "volume_over_sma_20"]


def training_rows(s, d):
    bars = durable(event_bars(s, d))
    x = ind.feature_matrix(bars).join(ind.labels(bars, 3, THR).select("symbol", "ts", "label", "future_ret"), ["symbol", "ts"])
    return durable(sp.number_labelled(x, "label", FEATS, step_seconds=HOUR))


def fitted(s, d, spec, label="label"):
    rows = sp.holdout(training_rows(s, d), 0.25)
    return md.fit_predict(rows, spec, FEATS, label=label, many_assets=True)


SPECS = {
    "forest_metrics": md.Learner(model="rf", size=15, depth=5),
    "boosting_metrics": md.Learner(model="hgb", size=4, depth=3),
    "mlp_metrics": md.Learner(model="mlp"),
}
for name, spec in SPECS.items():
    add(name, lambda s, d, spec=spec: rounded(md.evaluate(fitted(s, d, spec)[1], spec)))
REG = md.Learner(task="regression", model="hgb", size=5, depth=3)
add("regressor_metrics", lambda s, d: rounded(md.evaluate(fitted(s, d, REG, "future_ret")[1], REG, label="future_ret")))


def crossval(s, d):
    m, _ = md.cross_validate(sp.walk_forward(training_rows(s, d), n_splits=3), md.Learner(model="rf", size=8, depth=4), FEATS)
    return rounded(m)


add("walkforward_metrics", crossval)


def importance(s, d):
    model, _ = fitted(s, d, SPECS["forest_metrics"])
    return md.mean_importance(md.model_importance(model, FEATS, event_bars(s, d)), top=8)


add("model_importance", importance)


def permuted(s, d):
    spec = md.Learner(model="rf", size=8, depth=4)
    model, pred = fitted(s, d, spec)
    return rounded(md.permutation_importance(model, pred, spec, FEATS))


add("permutation_importance", permuted)


def sequence_rows(s, d):
    f = small_features(s, d)
    q = ind.sequences(f, COLS, 8)
    return q.select("symbol", "ts", F.size("sequence").alias("n"), F.round(F.get(F.get("sequence", F.lit(0)), F.lit(0)), 6).alias("first_return_1"))


add("sequences", sequence_rows,
    f"WITH {SQL_EVENT_BARS} {SQL_SMALL} SELECT symbol, ts, 8 AS n, round(lag(return_1, 7) {W}, 6) AS first_return_1 FROM sf QUALIFY bar_no >= 7")
