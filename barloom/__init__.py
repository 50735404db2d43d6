"""Market time-series analytics as Spark DataFrame operators."""
