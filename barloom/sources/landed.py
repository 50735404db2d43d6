"""Parsers for landed text: CSV lines, candle and macro payloads, symbol lists.

Each parser takes a DataFrame that holds the text, so that it works on files, on tables
and on streams of messages alike; the ``read_*`` functions are the file scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.expr import number, parse_ts
from barloom.session import small

DATE_COLUMNS = ("Date", "Datetime", "date", "datetime")
# fixed values: files of a dataset folder that are not series
ARTIFACTS = (
    "macro_features.csv", "extra_features_raw.csv", "portfolio_weights.csv", "spectral_clusters.csv", "dmd_eigs.csv",
)


def symbol_of_file(path: str | Column) -> Column:
    """File name before the first underscore, without the extension."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"([^/_]+?)(?:_[^/]*)?(?:\.csv)?$", 1)


def dataset_files(lines: DataFrame, path: str = "path") -> DataFrame:
    """Lines of per-symbol files: no artifacts, and of a dataset folder with an assets folder only the files in that.

    A file belongs to the folder it lies in and to the one above; each dataset folder is decided on its own.
    """
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    kept = lines.where(name.endswith(".csv") & ~name.isin(*ARTIFACTS) & ~name.endswith("_importance.csv"))
    inside = F.col(path).rlike("/assets/([^/]+/)?[^/]+$")
    root = F.regexp_extract(path, "^(.*)/assets/([^/]+/)?[^/]+$", 1)
    roots = small(kept.where(inside).select(root.alias("_root")).distinct())
    for above in ("^(.*)/[^/]+$", "^(.*)/[^/]+/[^/]+$"):
        kept = kept.withColumn("_root", F.when(~inside, F.regexp_extract(path, above, 1))).join(roots, "_root", "left_anti")
    return kept.drop("_root")


def parse_ohlcv_lines(lines: DataFrame, *, path: str = "path", value: str = "value") -> DataFrame:
    """CSV lines of many files, each with its own header, to (symbol, ts, open, ...).

    Files stay splittable: the header line of each file is found by its text and joined to the
    other lines of the file. Rows with an unreadable date are dropped, unreadable numbers are NULL.
    """
    is_header = F.col(value).rlike(r"(?i)^(date|datetime|unnamed[^,]*|),(.*,)?close(,|$)")
    cells = F.transform(F.split(value, ","), lambda c: F.trim(c))
    heads = lines.where(is_header).groupBy(path).agg(F.first(cells).alias("_h"))
    body = lines.where(~is_header & (F.length(F.trim(value)) > 0)).select(path, cells.alias("_c"))
    rows = body.join(heads, path)

    def pick(name: str) -> Column:
        return F.get("_c", (F.array_position("_h", name) - 1).cast("int"))

    dated = F.coalesce(*[F.when(F.array_contains("_h", c), pick(c)) for c in DATE_COLUMNS], F.get("_c", F.lit(0)))
    out = rows.select(
        symbol_of_file(path).alias("symbol"), parse_ts(dated).alias("ts"),
        *[number(pick(c)).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")],
    )
    return out.where(F.col("ts").isNotNull())


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    return df.select("value", F.col("_metadata.file_path").alias("path"))


def read_ohlcv(spark: SparkSession, folder: str) -> DataFrame:
    return parse_ohlcv_lines(dataset_files(read_lines(spark, folder)))


def read_exogenous(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Local CSV with a Date column (else the first one as date) and numeric columns."""
    df = spark.read.option("header", "true").csv(path)
    date = next((c for c in DATE_COLUMNS if c in df.columns), df.columns[0])
    return df.select(
        parse_ts(F.col(f"`{date}`")).alias("date"), *[number(F.col(f"`{c}`")).alias(c) for c in columns]
    ).where(F.col("date").isNotNull())


# fixed values: positions in a candle array
CANDLE_LAYOUTS = {
    "time_low_high_open_close_volume": {"open": 3, "high": 2, "low": 1, "close": 4, "volume": 5},
    "time_open_high_low_close_vwap_volume_count": {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 6},
}


def parse_candles(payloads: DataFrame, layout: str, *, value: str = "value") -> DataFrame:
    """JSON arrays of candle arrays with epoch seconds to (symbol, ts, open, ...)."""
    at = CANDLE_LAYOUTS[layout]
    c = payloads.select("symbol", F.explode(F.from_json(value, "array<array<string>>")).alias("_c"))
    second = F.get("_c", F.lit(0)).try_cast("double")
    return c.select(
        "symbol", F.timestamp_seconds(second).cast("timestamp_ntz").alias("ts"),
        *[number(F.get("_c", F.lit(i))).alias(n) for n, i in at.items()],
    ).where(F.col("ts").isNotNull())


def parse_macro(payloads: DataFrame, *, value: str = "value") -> DataFrame:
    """Observation payloads {"observations": [{"date", "value"}]}; a dot is a missing value."""
    schema = "observations array<struct<date:string,value:string>>"
    o = payloads.select("series_id", F.explode(F.from_json(value, schema)["observations"]).alias("_o"))
    out = o.select("series_id", F.col("_o.date").try_cast("date").alias("date"), number(F.col("_o.value")).alias("value"))
    return out.where(F.col("date").isNotNull())


def parse_annual(payloads: DataFrame, *, value: str = "value") -> DataFrame:
    """Annual indicator payloads [meta, [{"date": year, "value"}]] dated on January 1st."""
    rows = F.from_json(F.get_json_object(value, "$[1]"), "array<struct<date:string,value:string>>")
    o = payloads.select("country", "indicator", F.explode(rows).alias("_o"))
    year = F.col("_o.date").try_cast("int")
    return o.where(year.isNotNull()).select(
        F.concat_ws("_", F.lit("wb"), "country", "indicator").alias("series_id"),
        F.make_date(year, F.lit(1), F.lit(1)).alias("date"), number(F.col("_o.value")).alias("value"),
    )


def between_dates(macro: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    out = macro
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def parse_symbol_lines(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """One symbol per line; blanks and # comments are skipped."""
    s = F.upper(F.trim(value))
    return lines.select(s.alias("symbol"), *[c for c in lines.columns if c != value]).where((s != "") & ~s.startswith("#"))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols from a text file, or from the symbol, ticker or first column of a CSV."""
    if path.lower().endswith(".csv"):
        df = spark.read.option("header", "true").csv(path)
        named = {c.lower(): c for c in df.columns}
        c = next((named[n] for n in ("symbol", "ticker", "tickers") if n in named), df.columns[0])
        return parse_symbol_lines(df.select(F.col(f"`{c}`").alias("value")))
    return parse_symbol_lines(spark.read.text(path))
