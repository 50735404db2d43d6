"""Headlines and their sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import attach


def squeeze(text: str | Column) -> Column:
    """Whitespace runs to one blank, none at the ends."""
    t = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(t, r"[\s\p{Z}]+", " "))


def clean_headlines(rows: DataFrame, *, key: str = "ticker", text: str = "headline", pos: str = "pos") -> DataFrame:
    """Squeezed non-empty headlines, one per key and spelling in any case, the first kept.
    Copies are combined before the shuffle."""
    t = rows.select(key, squeeze(text).alias("_t"), pos).where(F.col("_t") != "")
    best = t.groupBy(key, F.lower("_t").alias("_k")).agg(F.min_by(F.struct("_t", pos), pos).alias("_b"))
    return best.select(key, F.col("_b._t").alias(text), F.col(f"_b.{pos}").alias(pos))


def first_headlines(cleaned: DataFrame, *, key: str = "ticker", pos: str = "pos", limit: int = 10, slices: int = 64) -> DataFrame:
    """The first ``limit`` headlines per key; a key's rows are thinned out slice by slice first."""
    s = cleaned.withColumn("_s", F.pmod(F.xxhash64(pos), F.lit(slices)))
    part = Window.partitionBy(key, "_s").orderBy(pos)
    s = s.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= limit)
    whole = Window.partitionBy(key).orderBy(pos)
    return s.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= limit).drop("_r", "_s")


def score_headlines(headlines: DataFrame, lexicon: DataFrame, *, ids: tuple[str, ...] = ("ticker", "pos"), text: str = "headline") -> DataFrame:
    """Adds sentiment in [-1, 1]: the sum s of the tokens' valences as s / sqrt(s² + 15).

    The lexicon (token, valence) is broadcast if its counted rows allow it. A headline's tokens
    sit in one partition, so sums are formed before the shuffle.
    """
    tokens = headlines.select(*ids, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}']+")).alias("token"))
    sums = attach(tokens, lexicon, "token").groupBy(*ids).agg(F.sum("valence").alias("_s"))
    s = F.coalesce("_s", F.lit(0.0))
    return headlines.join(sums, list(ids), "left").withColumn("sentiment", s / F.sqrt(s * s + 15.0)).drop("_s")


def mean_sentiment(scored: DataFrame) -> DataFrame:
    """Mean sentiment per ticker and headline, in long form."""
    return scored.groupBy("ticker", "headline").agg(F.avg("sentiment").alias("sentiment"))


def sentiment_matrix(scored: DataFrame, headlines: list[str]) -> DataFrame:
    """Ticker x headline with 0 where a ticker lacks one; for a short list of headlines."""
    return scored.groupBy("ticker").pivot("headline", headlines).agg(F.avg("sentiment")).fillna(0.0)
