"""Column helpers shared by all operators. A missing number is NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(x: str | Column, y: str | Column) -> Column:
    """x / y, NULL where y is 0 or missing (ANSI division would raise)."""
    return col(x) / F.nullif(col(y), F.lit(0.0))


def number(c: str | Column) -> Column:
    """Coerce text to a finite double; anything else becomes NULL."""
    return finite(col(c).try_cast("double"))


def finite(c: str | Column) -> Column:
    x = col(c)
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Bounded value that stays NULL when the input is NULL."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds(ts: str | Column) -> Column:
    return F.unix_seconds(col(ts).cast("timestamp"))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def is_truthy(c: str | Column) -> Column:
    """Text or boolean flag, as found in run summaries."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def parse_ts(c: str | Column) -> Column:
    """Text to TIMESTAMP_NTZ, NULL when it cannot be read; offsets are dropped."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return text.try_cast("timestamp_ntz")
