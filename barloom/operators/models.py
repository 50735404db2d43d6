"""Spark ML models on feature rows, and what is derived from their predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.metrics import classification_metrics, regression_metrics
from barloom.operators.splits import impute
from barloom.session import durable

REGRESSION = {"regression", "reg", "return"}
#: Rows are numbered within this many bits' ranges of hashes; the numbers do not depend on it.
HASH_BITS = 12


@dataclass(frozen=True)
class Learner:
    """Model choice. ``size`` is the number of trees, boosting rounds or training epochs."""

    task: str = "classification"
    model: str = "hgb"
    size: int | None = None
    depth: int | None = None
    seed: int = 42

    @property
    def is_regression(self) -> bool:
        return self.task.strip().lower() in REGRESSION


def estimator(spec: Learner, width: int):
    """Unfitted Spark ML estimator over the vector column ``features``."""
    name, reg = spec.model.strip().lower(), spec.is_regression
    if name in {"rf", "random_forest"}:
        cls = RandomForestRegressor if reg else RandomForestClassifier
        more = {} if reg else {"weightCol": "class_weight"}
        return cls(
            featuresCol="features", labelCol="target", numTrees=spec.size or (600 if reg else 800), minInstancesPerNode=3,
            maxDepth=spec.depth or 12, seed=spec.seed, **more,
        )
    if name in {"mlp", "nn"} and not reg:
        return MultilayerPerceptronClassifier(
            featuresCol="scaled", labelCol="target", layers=[width, 64, 64, 3], maxIter=spec.size or 300, seed=spec.seed
        )
    boost = dict(featuresCol="features", labelCol="target", maxIter=spec.size or 800, maxDepth=spec.depth or 6, stepSize=0.05, seed=spec.seed)
    return GBTRegressor(**boost) if reg else OneVsRest(
        classifier=GBTClassifier(**boost), featuresCol="features", labelCol="target", rawPredictionCol="rawPrediction"
    )


def pipeline(spec: Learner, features: Sequence[str], *, symbols: int | None = None) -> Pipeline:
    """symbols: number of training symbols if each gets a column (and one more for all others)."""
    stages, inputs, width = [], list(features), len(features)
    if symbols is not None:
        width += symbols + 1
        stages += [
            StringIndexer(inputCol="symbol", outputCol="_sym", handleInvalid="keep"),
            OneHotEncoder(inputCol="_sym", outputCol="_asset", dropLast=False),
        ]
        inputs.append("_asset")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    if spec.model.strip().lower() in {"mlp", "nn"}:
        stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True))
    return Pipeline(stages=[*stages, estimator(spec, width)])


def with_target(rows: DataFrame, spec: Learner, label: str = "label") -> DataFrame:
    """target for Spark ML: classes -1,0,1 become 0,1,2; rare classes weigh more."""
    if spec.is_regression:
        return rows.withColumn("target", F.col(label).cast("double"))
    rows = rows.withColumn("target", F.col(label).cast("double") + 1.0)
    counts = rows.where("role = 'train'").groupBy("target").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.join(F.broadcast(counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))))
    weights = counts.select("target", (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("class_weight"))
    return rows.join(F.broadcast(weights), "target", "left").fillna(1.0, ["class_weight"])


def fit_predict(
    rows: DataFrame, spec: Learner, features: Sequence[str], *, label: str = "label", many_assets: bool = False
) -> tuple[PipelineModel, DataFrame]:
    """Fit on role train, predict role test. Missing features take the training median."""
    ready = impute(rows, features, F.col("role") == "train").fillna(0.0, list(features))
    ready = durable(with_target(ready, spec, label))
    train = ready.where("role = 'train'")
    symbols = train.agg(F.count_distinct("symbol")).first()[0] if many_assets else None
    model = pipeline(spec, features, symbols=symbols).fit(train)
    out = model.transform(ready.where("role = 'test'"))
    return model, out if spec.is_regression else out.withColumn("prediction", F.col("prediction") - 1.0)


def evaluate(pred: DataFrame, spec: Learner, *, label: str = "label", key: Sequence[str] = ()) -> DataFrame:
    metric = regression_metrics if spec.is_regression else classification_metrics
    return metric(pred, label, "prediction", key=key)


def cross_validate(assigned: DataFrame, spec: Learner, features: Sequence[str], *, label: str = "label") -> tuple[DataFrame, DataFrame | None]:
    """One fit per walk-forward fold (seed + fold): metrics per fold, mean importance over folds."""
    assigned = durable(assigned)
    folds = sorted(r["fold"] for r in assigned.select("fold").distinct().collect())
    metrics, importances = None, None
    for f in folds:
        s = Learner(spec.task, spec.model, spec.size, spec.depth, spec.seed + f)
        model, pred = fit_predict(assigned.where(F.col("fold") == f), s, features, label=label, many_assets=True)
        m = evaluate(pred, s, label=label).withColumn("fold", F.lit(f))
        metrics = m if metrics is None else metrics.unionByName(m)
        i = model_importance(model, features, assigned)
        if i is not None:
            importances = i if importances is None else importances.unionByName(i)
    return metrics, mean_importance(importances) if importances is not None else None


def input_names(model: PipelineModel, features: Sequence[str]) -> list[str]:
    """Names of a fitted model's inputs in order: the features, then the columns of the training symbols."""
    symbols = [label for stage in model.stages if isinstance(stage, StringIndexerModel) for label in stage.labels]
    return [*features, *[f"asset_{s}" for s in symbols], *(["asset_other"] if symbols else [])]


def model_importance(model: PipelineModel, features: Sequence[str], like: DataFrame) -> DataFrame | None:
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return None
    rows = zip(input_names(model, features), last.featureImportances.toArray(), strict=True)
    return like.sparkSession.createDataFrame([(f, float(v)) for f, v in rows], "feature string, importance double")


def mean_importance(importances: DataFrame, top: int | None = None) -> DataFrame:
    out = importances.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out


def permutation_importance(
    model: PipelineModel, test: DataFrame, spec: Learner, features: Sequence[str], *, label: str = "label", repeats: int = 8
) -> DataFrame:
    """Drop of the score (macro F1 or R²) when one input (also an asset column) is taken from another row.

    Each repeat numbers all rows twice, in the order of two hashes; the rows with equal numbers are
    partners, and a row is scored once per input with that input from its partner. The number is the
    place among the rows of one range of hashes plus the sizes of the ranges before it. Hashes instead
    of rand() keep a recomputed partition identical when an executor is lost.
    """
    last = model.stages[-1]
    vec = "scaled" if "scaled" in [getattr(s, "getOutputCol", lambda: "")() for s in model.stages[:-1]] else "features"
    base = test.select(label, "symbol", "row_no", vector_to_array(vec).alias("_x"))
    r = base.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def mix(salt: int) -> Column:
        return F.xxhash64(F.lit(spec.seed + salt), "_r", "symbol", "row_no")

    def numbered(df: DataFrame, salt: int, name: str) -> DataFrame:
        df = df.withColumn("_b", F.shiftright(mix(salt), 64 - HASH_BITS))
        sizes = df.groupBy("_r", "_b").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("_r", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        inside = F.row_number().over(Window.partitionBy("_r", "_b").orderBy(mix(salt), "symbol", "row_no"))
        return df.join(starts, ["_r", "_b"]).withColumn(name, F.col("_start") + inside).drop("_b", "_start")

    r = durable(numbered(numbered(r, 1, "_k"), 2, "_j"))
    partner = r.select("_r", F.col("_j").alias("_k"), F.col("_x").alias("_y"))
    paired = r.drop("_j").join(partner, ["_r", "_k"])
    inputs = input_names(model, features)
    swapped = F.transform("_x", lambda v, i: F.when(i == F.col("_f"), F.get(F.col("_y"), i)).otherwise(v))
    trials = paired.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(inputs) - 1)))).select(
        "_r", "_f", label, array_to_vector(swapped).alias(vec)
    )
    score = "r2" if spec.is_regression else "f1_macro"
    shift = 0.0 if spec.is_regression else 1.0

    def scored(df: DataFrame, key: Sequence[str]) -> DataFrame:
        p = last.transform(df).withColumn("prediction", F.col("prediction") - shift)
        return evaluate(p, spec, label=label, key=key).select(*key, F.col(score).alias("_score"))

    whole = scored(test.select(label, vec), ()).withColumnRenamed("_score", "_base")
    names = F.array(*[F.lit(f) for f in inputs])
    out = scored(trials, ("_r", "_f")).groupBy("_f").agg(F.avg("_score").alias("_s")).join(F.broadcast(whole))
    return out.select(F.get(names, F.col("_f")).alias("feature"), (F.col("_base") - F.col("_s")).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


# ---- predictions to signals ------------------------------------------------------------------


def class_signal(prediction: str = "prediction", *, zero_based: bool = False) -> Column:
    p = F.col(prediction).cast("double")
    return p - 1.0 if zero_based else p


def predicted_signal(pred: DataFrame, *, task: str = "classification", threshold: float = 0.0, prediction: str = "prediction") -> DataFrame:
    """Regression by threshold; classes as they are, or shifted when a class above 1 occurs."""
    p = F.col(prediction)
    if task in REGRESSION:
        return pred.withColumn("signal", F.when(p > threshold, 1.0).when(p < -threshold, -1.0).otherwise(0.0))
    base = pred.agg((F.max(p) > 1).alias("_zero_based"))
    out = pred.join(F.broadcast(base))
    return out.withColumn("signal", F.when(F.col("_zero_based"), p - 1.0).otherwise(p.cast("double"))).drop("_zero_based")


def probability_signal(p_buy: Column, p_sell: Column, *, enter: float = 0.55, allow_short: bool = True) -> Column:
    """Buy at the entry probability; a sell at its entry probability overrides it."""
    sell = F.coalesce(p_sell >= enter, F.lit(False)) if allow_short else F.lit(False)
    return F.when(sell, -1.0).when(p_buy >= enter, 1.0).otherwise(0.0)


def class_probabilities(pred: DataFrame) -> DataFrame:
    """p_sell and p_buy from a model's probability, or from normalised one-vs-rest margins."""
    if "probability" in pred.columns:
        p = vector_to_array("probability")
    else:
        raw = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
        p = F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))
    return pred.withColumns({"p_sell": F.get(p, F.lit(0)), "p_buy": F.get(p, F.lit(2))})
