"""Time-respecting splits over numbered, labelled rows (symbol, row_no)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import number_rows
from barloom.operators.order_stats import medians
from barloom.session import attach, durable


def number_labelled(rows: DataFrame, label: str, features: Sequence[str] = (), *, step_seconds: int = 86_400) -> DataFrame:
    """Rows with a label (and some feature), numbered per symbol, with the symbol's row count."""
    kept = rows.where(F.col(label).isNotNull())
    if features:
        kept = kept.dropna(how="all", subset=list(features))
    kept = durable(kept)
    n = kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = number_rows(kept, step_seconds=step_seconds, name="row_no")
    return attach(kept, n)


def holdout(rows: DataFrame, test_size: float = 0.2, *, min_rows: int = 80) -> DataFrame:
    """role train or test; the cut leaves at least 30 and 10 rows; short symbols are left out."""
    if not 0.05 <= test_size <= 0.8:
        raise ValueError("test_size must be between 0.05 and 0.8")
    cut = F.greatest(F.lit(30), F.least(F.floor(F.col("n_rows") * (1.0 - test_size)), F.col("n_rows") - 10))
    return rows.where(F.col("n_rows") >= min_rows).withColumn("role", F.when(F.col("row_no") < cut, "train").otherwise("test"))


def fold_table(sizes: DataFrame, *, n_splits: int = 5, test_window: int = 20, purge: int = 5, min_train: int = 60) -> DataFrame:
    """(symbol, fold, train_end, test_start, test_end): train is [0, train_end), test is
    [test_start, test_end). Symbols with fewer than two usable folds are left out."""
    if n_splits < 2 or test_window < 5 or purge < 0:
        raise ValueError("need n_splits >= 2, test_window >= 5, purge >= 0")
    first, last = float(max(min_train, purge)), F.col("n_rows") - test_window
    step = (last - first) / float(n_splits - 1)
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(n_splits - 1)),
        lambda i: F.when(i == n_splits - 1, last.cast("double")).otherwise(i * step + first).cast("long"),
    )
    usable = F.filter(
        F.array_distinct(starts),
        lambda s: (s - purge >= min_train) & (F.least(F.col("n_rows"), s + test_window) - s >= 5),
    )
    t = sizes.where(last > first).withColumn("_s", usable).where(F.size("_s") >= 2)
    return t.select("symbol", "n_rows", F.posexplode("_s").alias("_i", "test_start")).select(
        "symbol", (F.col("_i") + 1).alias("fold"), (F.col("test_start") - purge).alias("train_end"), "test_start",
        F.least("n_rows", F.col("test_start") + test_window).alias("test_end"),
    )


def walk_forward(rows: DataFrame, *, aligned: bool = True, min_rows: int = 120, **params) -> DataFrame:
    """Each row once per fold it takes part in, with fold and role. ``aligned`` keeps only the
    folds every symbol has, so that fold i of all symbols can be trained together."""
    sizes = rows.where(F.col("n_rows") >= min_rows).select("symbol", "n_rows").distinct()
    folds = fold_table(sizes, **params)
    if aligned:
        per = folds.groupBy("symbol").agg(F.max("fold").alias("_m"))
        folds = folds.join(F.broadcast(per.agg(F.min("_m").alias("_m")))).where("fold <= _m").drop("_m")
    # one row per symbol to join, folds inside it
    packed = folds.groupBy("symbol").agg(F.collect_list(F.struct("fold", "train_end", "test_start", "test_end")).alias("_f"))
    x = attach(rows, packed).withColumn("_e", F.explode("_f"))
    no = F.col("row_no")
    role = F.when(no < F.col("_e.train_end"), "train").when(
        (no >= F.col("_e.test_start")) & (no < F.col("_e.test_end")), "test"
    )
    return x.withColumn("fold", F.col("_e.fold")).withColumn("role", role).where("role IS NOT NULL").drop("_f", "_e")


def fold_rollup(assigned: DataFrame) -> DataFrame:
    """Per fold over all symbols: earliest and latest train end, test start and test end."""
    per = assigned.groupBy("fold", "symbol").agg(
        F.max(F.when(F.col("role") == "train", F.col("ts"))).alias("train_end"),
        F.min(F.when(F.col("role") == "test", F.col("ts"))).alias("test_start"),
        F.max(F.when(F.col("role") == "test", F.col("ts"))).alias("test_end"),
    )
    return per.groupBy("fold").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("train_end", "test_start", "test_end") for n, f in (("min", F.min), ("max", F.max))]
    )


def sweep_split(rows: DataFrame, train_frac: float = 0.65, *, purge: int = 0) -> DataFrame:
    """Earlier part trains, later part tests; the minimums soften below 40 rows."""
    n = F.col("n_rows")
    small = n < 40
    min_train = F.when(small, F.greatest(F.lit(5), F.floor(n * 0.6))).otherwise(30)
    min_test = F.when(small, F.greatest(F.lit(3), n - min_train)).otherwise(10)
    cut = F.least(n - min_test, F.greatest(min_train, F.floor(n * train_frac)))
    role = F.when(F.col("row_no") < cut - purge, "train").when(F.col("row_no") >= cut, "test")
    return rows.where((cut > 0) & (cut < n)).withColumn("role", role)


def final_fit(rows: DataFrame, purge: int = 5) -> DataFrame:
    return rows.where(F.col("row_no") < F.col("n_rows") - purge)


def one_hot(rows: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Columns asset_<symbol> with 0 or 1, for a known universe."""
    return rows.withColumns({f"asset_{s}": (F.col("symbol") == s).cast("int") for s in symbols})


def train_medians(rows: DataFrame, features: Sequence[str], train: Column) -> DataFrame:
    """Exact median of each feature over the training rows, one row per feature."""
    long = rows.where(train).select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "feature", "value")
    return medians(long, ["feature"], "value")


def impute(rows: DataFrame, features: Sequence[str], train: Column) -> DataFrame:
    """Fill missing features with the training medians (one number per feature comes back)."""
    fill = {r["feature"]: r["median"] for r in train_medians(rows, features, train).collect()}
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fill.get(c))) for c in features})
