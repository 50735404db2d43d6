"""Fitted models on a separable set with two symbols: scores, seeds, and asset columns in both importances."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import models as md
from barloom.operators import report
from barloom.sources import landed

FEATURES = ["x", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(240).select(
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("symbol"), F.col("id").alias("row_no"),
        ((F.col("id") * 7) % 3 - 1).cast("double").alias("x"), F.rand(5).alias("noise"), F.when(F.col("id") < 180, "train").otherwise("test").alias("role"))
    return r.withColumn("label", F.col("x").cast("int"))


@pytest.mark.parametrize("name", ["rf", " MLP "])
def test_learners_beat_the_majority_class(rows, name):
    spec = md.Learner(model=name, size=20, depth=3)
    scores = [md.evaluate(md.fit_predict(rows, spec, FEATURES, many_assets=True)[1], spec).first() for _ in range(2)]
    assert scores[0]["f1_macro"] > 0.9 and scores[0] == scores[1]


def test_importances_name_every_input(rows):
    spec = md.Learner(model="rf", size=10, depth=3)
    model, pred = md.fit_predict(rows, spec, FEATURES, many_assets=True)
    names = {"x", "noise", "asset_A", "asset_B", "asset_other"}
    gain = {r["feature"]: r["importance"] for r in md.model_importance(model, FEATURES, rows).collect()}
    drop = {r["feature"]: r["importance"] for r in md.permutation_importance(model, pred, spec, FEATURES, repeats=2).collect()}
    assert set(gain) == set(drop) == names
    assert max(gain, key=gain.get) == max(drop, key=drop.get) == "x" and drop["asset_other"] == 0


def test_dataset_folders_are_decided_one_by_one(spark):
    paths = ["/d/one/assets/A_1.csv", "/d/one/B_1.csv", "/d/two/C_1.csv", "/d/two/sub/D_1.csv"]
    got = landed.dataset_files(spark.createDataFrame([(p, "v") for p in paths], "path string, value string"))
    assert sorted(r["path"] for r in got.collect()) == [paths[0], paths[2], paths[3]]


def test_core_model_names_a_run_without_model(spark):
    flags = [f"false AS {f}" for f in report.FLAGS]
    r = spark.sql("SELECT CAST(NULL AS string) AS model, 'RandomForest' AS core_model, '' AS wavelet_kernel, CAST(NULL AS int) AS wavelet_ar_p, " + ", ".join(flags))
    assert report.combo_label(r).first()["feature_combo"] == "rf"
