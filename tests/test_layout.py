import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators.layout import carried, ewm, number_rows, over_blocks
from barloom.operators.order_stats import average_ranks, medians


@pytest.fixture(scope="module")
def walk(make_bars):
    rng = np.random.default_rng(1)
    return make_bars({"A": 100 + rng.normal(size=150).cumsum(), "B": 50 + rng.normal(size=40).cumsum()}).cache()


def test_number_rows_over_many_buckets(walk):
    n = number_rows(walk.withColumnRenamed("bar_no", "want"), step_seconds=60)
    assert n.where("bar_no <> want").count() == 0 and n.count() == 190


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_frames_do_not_depend_on_blocks(walk, block):
    want = walk.toPandas().sort_values(["symbol", "ts"])
    want["sma"] = want.groupby("symbol")["close"].transform(lambda x: x.rolling(20).mean())
    want["lead"] = want.groupby("symbol")["close"].shift(-3)
    got = over_blocks(
        walk, lambda f: {"sma": f.full(F.avg, F.col("close"), 20), "lead": f.lead("close", 3)}, back=20, ahead=3, block=block
    ).toPandas().sort_values(["symbol", "ts"])
    assert len(got) == len(want)
    np.testing.assert_allclose(got["sma"], want["sma"])
    np.testing.assert_allclose(got["lead"], want["lead"])


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_carried_totals(walk, block):
    got = carried(
        walk.withColumn("gappy", F.when(F.col("bar_no") % 7 == 3, F.col("close"))),
        {"s": ("sum", F.col("close")), "m": ("max", F.col("close")), "p": ("product", F.col("close") / 100), "l": ("last", F.col("gappy"))},
        block=block,
    ).toPandas().sort_values(["symbol", "ts"])
    g = got.groupby("symbol")
    np.testing.assert_allclose(got["s"], g["close"].cumsum())
    np.testing.assert_allclose(got["m"], g["close"].cummax())
    np.testing.assert_allclose(got["p"], (got["close"] / 100).groupby(got["symbol"]).cumprod())
    np.testing.assert_allclose(got["l"], g["gappy"].ffill())


@pytest.mark.parametrize("block", [None, 16, 64])
def test_ewm_with_gaps_is_that_of_pandas(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300).cumsum()
    x[:3] = x[100:160] = np.nan
    x[::17] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "bar_no": range(300), "x": x})).withColumn("x", F.nanvl("x", F.lit(None)))
    got = ewm(df, {"y": ("x", 1 / 14, 5), "z": ("x", 2 / 13, 1)}, block=block).orderBy("bar_no").toPandas()
    np.testing.assert_allclose(got["y"], pd.Series(x).ewm(alpha=1 / 14, adjust=False, min_periods=5).mean(), atol=1e-9)
    np.testing.assert_allclose(got["z"], pd.Series(x).ewm(alpha=2 / 13, adjust=False, min_periods=1).mean(), atol=1e-9)


def test_rsi_is_missing_without_losses(make_bars):
    assert ind.rsi(make_bars({"A": range(1, 31)})).where("rsi_14 IS NOT NULL").count() == 0


def test_order_statistics(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 5000, p=[0.9, 0.1]), "x": np.round(rng.normal(size=5000), 2)})
    df = spark.createDataFrame(pdf)
    got = {r["k"]: r["median"] for r in medians(df, ["k"], "x").collect()}
    assert got == pytest.approx(pdf.groupby("k")["x"].median().to_dict())
    ranks = average_ranks(df.withColumn("i", F.monotonically_increasing_id()), ["k"], "x").toPandas()
    np.testing.assert_allclose(ranks["rank"], ranks.groupby("k")["x"].rank())
