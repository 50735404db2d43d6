"""Writing datasets, models and run results."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dataset(bars: DataFrame, path: str, *, rows_per_file: int = 5_000_000, fmt: str = "parquet") -> None:
    """One folder per shard (first character) and symbol. Rows are spread by symbol and year, so
    a symbol with many rows is written by many tasks; large files are cut."""
    df = bars.withColumn("shard", F.substring("symbol", 1, 1)).repartition("symbol", F.year("ts"))
    w = df.write.mode("overwrite").partitionBy("shard", "symbol").option("maxRecordsPerFile", rows_per_file)
    (w.option("header", "true") if fmt == "csv" else w).format(fmt).save(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("shard")


def write_model(model: PipelineModel, metrics: DataFrame, importance: DataFrame | None, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    if importance is not None:
        importance.write.mode("overwrite").option("header", "true").csv(f"{path}/feature_importance")


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
