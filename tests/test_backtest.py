import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import metrics as mx

FREE = bt.Rules(cost_bps=0.0, delay=0)


def test_flip_costs_two_and_makes_two_trades(make_bars):
    bars = make_bars({"A": [10, 11, 12, 11, 10, 9]}, signal=[-1, -1, 1, 1, 0, 0])
    c = bt.equity_curve(bars, bt.Rules(delay=1)).orderBy("bar_no").collect()
    assert [r["position"] for r in c] == [0, -1, -1, 1, 1, 0]
    assert [r["turnover"] for r in c] == [0, 1, 0, 2, 0, 1]
    t = bt.trades_from_positions(bt.equity_curve(bars, bt.Rules(delay=1))).orderBy("entry_ts").collect()
    assert [r["side"] for r in t] == ["short", "long"]
    assert t[0]["ret"] == pytest.approx(0.0) and t[1]["ret"] == pytest.approx(9 / 11 - 1)


def test_flat_price_has_no_scale_and_no_error(make_bars):
    bars = make_bars({"A": [5] * 40}, signal=[1] * 40)
    c = bt.equity_curve(bars, bt.Rules(vol_target=0.1))
    assert c.where("position <> 0").count() == 0
    m = mx.curve_metrics(c).first()
    assert m["max_drawdown"] == 0 and m["sharpe"] is None and m["total_return"] == 0


def test_monotone_series_has_no_drawdown(make_bars):
    m = mx.curve_metrics(bt.equity_curve(make_bars({"A": range(1, 30)}, signal=[1] * 29), FREE)).first()
    assert m["max_drawdown"] == 0 and m["n_position_changes"] == 0


def hit_bar(make_bars):
    # bar 2 touches both the stop (9) and the target (12)
    return make_bars({"A": [10, 10, 10, 10, 10, 10]}, high=[10, 10, 13, 10, 10, 10], low=[10, 10, 8, 10, 10, 10], signal=[0, 1, 1, 1, 0, 0])


@pytest.mark.parametrize("tp_first, reason, price", [(False, "stop_loss", 9.0), (True, "take_profit", 12.0)])
def test_stop_beats_target_unless_asked(make_bars, tp_first, reason, price):
    b = bt.Barriers(stop_loss=0.1, take_profit=0.2, take_profit_first=tp_first)
    t = bt.barrier_trades(bt.barrier_bars(hit_bar(make_bars), FREE, b)).orderBy("entry_ts").collect()
    assert t[0]["exit_reason"] == reason and t[0]["exit_price"] == pytest.approx(price)
    # the signal persists: a new trade on the next bar, closed by the signal
    assert t[1]["entry_ts"].day == 4 and t[1]["exit_reason"] == "signal"


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_barriers_do_not_depend_on_chunks(make_bars, chunk):
    import numpy as np

    rng = np.random.default_rng(3)
    c = 100 * np.exp(rng.normal(scale=0.05, size=60).cumsum())
    bars = make_bars({"A": c}, high=c * 1.03, low=c * 0.97, signal=[1] * 25 + [-1] * 25 + [0] * 10).cache()
    b = bt.Barriers(stop_loss=0.08, take_profit=0.3, trailing_stop=0.1, trailing_atr_mult=1.5)
    got = bt.barrier_trades(bt.barrier_bars(bars, FREE, b, chunk=chunk)).orderBy("entry_ts", "exit_ts").collect()
    want = bt.barrier_trades(bt.barrier_bars(bars, FREE, b)).orderBy("entry_ts", "exit_ts").collect()
    assert got == want and len(want) > 3


def test_trade_metrics_without_losses(spark):
    t = spark.createDataFrame([("A", 0.1), ("A", 0.3)], "symbol string, ret double")
    m = mx.trade_metrics(t).first()
    assert m["win_loss_ratio"] == float("inf") and m["profit_factor"] == float("inf") and m["median_trade_return"] == pytest.approx(0.2)


def test_long_only_rounds_half_to_even(spark):
    s = spark.createDataFrame([(0.5,), (1.5,), (-0.6,), (None,)], "signal double")
    assert [r[0] for r in s.select(bt.direction("signal")).collect()] == [0.0, 1.0, -1.0, 0.0]
    assert [r[0] for r in s.select(bt.direction("signal", "long")).collect()] == [0.0, 1.0, 0.0, 0.0]


def test_equal_weights_sum_to_one(make_bars):
    c = bt.equity_curve(make_bars({"A": [1, 2, 3], "B": [3, 2, 1]}, signal=[1, 1, 1]), FREE)
    w = bt.portfolio_weights(c.select("symbol", "ts", "bar_no", "strategy_ret"))
    assert w.groupBy("ts").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-12").count() == 0
