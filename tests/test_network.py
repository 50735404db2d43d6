import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import network as nw


def edges(spark, pairs):
    both = [(a, b, float(w)) for a, b, w in pairs] + [(b, a, float(w)) for a, b, w in pairs]
    return spark.createDataFrame(both, "src string, dst string, w double").withColumn("t_no", F.lit(0))


def test_fiedler_solves_the_laplacian(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 0.5), ("c", "d", 1), ("a", "c", 0.2)])
    v = {r["symbol"]: r["fiedler"] for r in nw.fiedler_vectors(e).collect()}
    value = nw.fiedler_vectors(e).first()["fiedler_value"]
    lv = dict.fromkeys(v, 0.0)
    for r in nw.laplacian(e).collect():
        lv[r["src"]] += r["value"] * v[r["dst"]]
    for k in v:
        assert lv[k] == pytest.approx(value * v[k], abs=1e-10)
    assert v["a"] > 0


def test_two_components_skip_every_zero(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("x", "y", 1)])
    assert nw.fiedler_vectors(e).first()["fiedler_value"] > 1e-10


def test_centralities(spark):
    path = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    score = {r["symbol"]: r["score"] for r in nw.centrality(path, "betweenness").collect()}
    assert score == pytest.approx({"a": 0, "b": 2 / 3, "c": 2 / 3, "d": 0})
    square = edges(spark, [("a", "b", 1), ("b", "d", 1), ("a", "c", 1), ("c", "d", 1)])
    score = {r["symbol"]: r["score"] for r in nw.centrality(square, "betweenness").collect()}
    assert score == pytest.approx(dict.fromkeys("abcd", 1 / 6))
    rank = nw.centrality(path, "pagerank").toPandas()["score"]
    assert rank.sum() == pytest.approx(1)
    two = edges(spark, [("a", "b", 1), ("x", "y", 1), ("y", "z", 1)])
    assert nw.centrality(two, "eigenvector").exceptAll(nw.centrality(two, "pagerank")).count() == 0


def test_rank_correlation_within_pairs(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(80, 8)), 1)  # many ties
    x[rng.random(size=x.shape) < 0.25] = np.nan
    x[:, 3], x[:, 4] = np.where(np.isfinite(x[:, 2]), x[:, 3], np.nan), np.nan
    x[5, 4] = 1.0
    frame = pd.DataFrame(x, columns=list("abcdefgh"), index=pd.date_range("2024-01-01", periods=80))
    long = frame.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="ret").dropna()
    r = spark.createDataFrame(long).withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()
    # pandas: rank the two columns over the rows that both have
    want = {(a, b): frame[[a, b]].dropna().rank().corr().iloc[0, 1] for a in frame for b in frame if a < b}
    size = {(a, b): len(frame[[a, b]].dropna()) for a, b in want}
    for tile in (2, 128):
        got = {(row["src"], row["dst"]): row for row in nw.correlation_pairs(r, method="spearman", tile=tile).collect()}
        assert set(got) == {k for k in want if size[k]}
        for k, row in got.items():
            assert row["n"] == size[k] and row["corr"] == pytest.approx(0.0 if np.isnan(want[k]) else want[k])


def test_correlation_tiles_with_gaps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 7))
    x[rng.random(size=x.shape) < 0.2] = np.nan
    frame = pd.DataFrame(x, columns=list("abcdefg"), index=pd.date_range("2024-01-01", periods=90))
    long = frame.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="ret").dropna()
    r = spark.createDataFrame(long).withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()
    want = frame.corr()
    for row in nw.correlation_pairs(r, tile=3).collect():
        assert row["corr"] == pytest.approx(want.loc[row["src"], row["dst"]])
    got = nw.rolling_networks(r, window=30, k=2, stretch=32, tile=3).toPandas()
    stamps = sorted(got["ts"].unique())
    assert len(stamps) == 61
    for ts in stamps[::20]:
        sim = (frame[:ts].tail(30).corr().abs().fillna(0) + 1) / 2
        adj = np.zeros((7, 7))
        for i in range(7):
            row = sim.to_numpy()[i].copy()
            row[i] = 0
            top = np.argsort(row)[::-1][:2]
            adj[i, top] = row[top]
        adj = np.maximum(adj, adj.T)
        g = got[got["ts"] == ts]
        have = np.zeros((7, 7))
        have[[ord(c) - 97 for c in g["src"]], [ord(c) - 97 for c in g["dst"]]] = g["w"]
        np.testing.assert_allclose(have, adj)


def test_allocation_sums_to_one_and_splits_risk(spark):
    rng = np.random.default_rng(9)
    rows = [(s, d, float(v)) for s in "abcd" for d, v in zip(pd.date_range("2024-01-01", periods=70), rng.normal(size=70))]
    r = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "ret"]))
    c = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "symbol string, cluster int")
    a = nw.allocate(r, c, within_cluster="equal", cluster_budget="equal").toPandas().set_index("symbol")
    assert a["weight"].sum() == pytest.approx(1) and a["risk_contrib_diag"].sum() == pytest.approx(1)
    assert a.loc["c", "weight"] == pytest.approx(0.5) and a.loc["d", "cluster"] == 0
