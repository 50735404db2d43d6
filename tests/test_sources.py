import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as ob
from barloom.operators import models as md
from barloom.operators import report as rp
from barloom.operators import sweep as sw
from barloom.sources import feeds, landed, runs, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_ohlcv_files_with_different_headers(spark, tmp_path):
    write(tmp_path / "assets/A/AAPL_1y_1d.csv", "Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,\nbad,1,1,1,1,1\n2024-01-03,x,2,1,1.5,7\n")
    write(tmp_path / "assets/EURUSD=X_1y_1h.csv", ",Close,Open,High,Low\n2024-01-02 10:00:00+00:00,1.1,1.0,1.2,0.9\n")
    write(tmp_path / "assets/macro_features.csv", "Date,GDP\n2024-01-02,1\n")
    write(tmp_path / "OLD_1y_1d.csv", "Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,3\n")
    got = {(r["symbol"], str(r["ts"])): r for r in landed.read_ohlcv(spark, str(tmp_path)).collect()}
    assert set(got) == {("AAPL", "2024-01-02 00:00:00"), ("AAPL", "2024-01-03 00:00:00"), ("EURUSD=X", "2024-01-02 10:00:00")}
    assert got["AAPL", "2024-01-02 00:00:00"]["volume"] is None and got["AAPL", "2024-01-03 00:00:00"]["open"] is None
    assert got["EURUSD=X", "2024-01-02 10:00:00"]["close"] == 1.1


def test_symbol_files_and_exogenous_csv(spark, tmp_path):
    write(tmp_path / "u.txt", "aapl\n# no\n\n msft \n")
    write(tmp_path / "u.csv", "name,ticker\nApple,aapl\n")
    write(tmp_path / "x.csv", "day,rate\n2024-01-01,5.5\nnone,1\n")
    assert sorted(r[0] for r in landed.read_symbols(spark, str(tmp_path / "u.txt")).collect()) == ["AAPL", "MSFT"]
    assert [r[0] for r in landed.read_symbols(spark, str(tmp_path / "u.csv")).collect()] == ["AAPL"]
    assert [r["rate"] for r in landed.read_exogenous(spark, str(tmp_path / "x.csv"), ["rate"]).collect()] == [5.5]


def test_feeds(spark):
    rss = "<rss><channel><item><title><![CDATA[A &amp; B]]></title><pubDate>Tue, 09 Jan 2024 15:42:00 GMT</pubDate></item><item><title>C</title></item></channel></rss>"
    atom = "<feed><entry><title>D</title><updated>2024-01-09T15:42:00Z</updated></entry></feed>"
    df = spark.createDataFrame([("r", rss), ("a", atom), ("n", "<x/>")], "ticker string, xml string")
    got = {(r["ticker"], r["pos"]): (r["title"], str(r["ts"])) for r in feeds.feed_items(df).collect()}
    assert got == {("r", 0): ("A & B", "2024-01-09 15:42:00"), ("r", 1): ("C", "None"), ("a", 0): ("D", "2024-01-09 15:42:00")}


def test_run_folders(spark, tmp_path):
    m = {"start": "2024-01-01", "end": "2024-02-01", "n_bars": 30, "sharpe": float("nan"), "total_return": 0.1}
    single = {"asset": "BTC-USD", "model": "hgb", "mode": "long", "stop_loss": None, "uses_hmm": True, "metrics": m}
    port = {"inputs": ["a", "b"], "model": "rf", "portfolio_metrics": {**m, "sharpe": 1.5}}
    for name, s in (("bt_one", single), ("bt_two", port), ("other", single)):
        write(tmp_path / name / "backtest_summary.json", json.dumps(s, indent=2))
    write(tmp_path / "bt_two" / "assets_metrics.csv", "start,end,n_bars,sharpe,asset\n2024,2024,30,2.5,BTC-USD\n2024,2024,30,1.0,EURUSD=X\n")
    write(tmp_path / "bt_one" / "trades.csv", "\n")
    write(tmp_path / "bt_two" / "trades.csv", "entry_time,exit_time,side,entry_price,exit_price,return,exit_reason\n2024-01-01,2024-01-02,long,1,2,1.0,signal\n")
    rows = rp.report_rows(runs.read_summaries(spark, str(tmp_path))).orderBy("run").collect()
    assert [r["run"] for r in rows] == ["bt_one", "bt_two"]
    assert rows[0]["feature_combo"] == "hgb+long_only+hmm" and rows[1]["m_sharpe"] == 1.5 and rows[1]["is_portfolio"]
    assert rows[0]["t_n_trades"] is None
    assert runs.read_trades(spark, str(tmp_path)).count() == 1
    a = runs.read_asset_metrics(spark, str(tmp_path)).where("metric = 'sharpe'").collect()
    assert {(r["asset"], r["value"]) for r in a} == {("BTC-USD", 2.5), ("EURUSD=X", 1.0)}
    flat = rp.ranked_runs(rp.report_rows(runs.read_summaries(spark, str(tmp_path))), drop_flat=True)
    assert [r["run"] for r in flat.collect()] == ["bt_two"]


def test_dataset_and_model_round_trip(spark, make_bars, tmp_path):
    bars = make_bars({"AAA": range(1, 60), "BBB": range(60, 1, -1)})
    sinks.write_dataset(bars, str(tmp_path / "d"))
    assert sinks.read_dataset(spark, str(tmp_path / "d")).count() == bars.count()
    rows = bars.withColumns({"row_no": F.col("bar_no"), "label": (F.col("bar_no") % 3 - 1).cast("int"), "x": (F.col("bar_no") % 3).cast("double"),
                             "y": F.when(F.col("bar_no") % 5 != 0, F.col("close")), "role": F.when(F.col("bar_no") < 45, "train").otherwise("test")})
    spec = md.Learner(model="rf", size=5, depth=3)
    model, pred = md.fit_predict(rows, spec, ["x", "y"])
    metrics = md.evaluate(pred, spec)
    assert metrics.first()["accuracy"] == 1.0
    imp = md.permutation_importance(model, pred, spec, ["x", "y"], repeats=2).collect()
    assert imp[0]["feature"] == "x" and imp[0]["importance"] > 0.1
    sinks.write_model(model, metrics, md.model_importance(model, ["x", "y"], rows), str(tmp_path / "m"))
    again = sinks.read_model(str(tmp_path / "m")).transform(pred.drop("features", "rawPrediction", "probability", "prediction"))
    assert again.where("prediction <> label + 1").count() == 0


def test_cleaning_guards(spark, make_bars):
    with pytest.raises(ValueError):
        ob.require_columns(make_bars({"A": [1]}), ("open", "spread"))
    df = spark.createDataFrame([(i, 1.0, None) for i in range(3)], "i int, a double, b double")
    assert ob.drop_null_columns(df, F.lit(True), ["a", "b"], keep_at_least=1).columns == ["i", "a"]
    assert ob.drop_null_columns(df, F.lit(True), ["a", "b"], keep_at_least=2).columns == ["i", "a", "b"]


def test_variant_grid(spark):
    g = sw.variant_grid(spark).toPandas()
    assert len(g) == 60 and g["name"].is_unique and {"hgb_baseline", "rf_wv_cwt_ricker_ar5", "mlp_proba_hmm_wavelet"} <= set(g["name"])
    assert g.loc[g["name"] == "hgb_stops", "stop_loss"].item() == 0.01
