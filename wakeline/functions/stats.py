"""Statistics and scale functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours of two timestamps with or without zone."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def entropy_by(rows: DataFrame, key: str, value: str, base: float | None = None, one_value: float | None = 0.0) -> DataFrame:
    """(key, entropy): Shannon entropy of ``value`` over its number of values (or ``base``); NULL without any."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").cast("double").alias("_n"))
    totals = counts.groupBy(key).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.log("_n")).alias("_s"), F.count("*").alias("_k"))
    nats = F.log("_t") - F.col("_s") / F.col("_t")
    scaled = nats / F.log(F.lit(base)) if base else F.when(F.col("_k") > 1, nats / F.log(F.col("_k").cast("double"))).otherwise(F.lit(one_value))
    return totals.select(key, scaled.alias("entropy"))


def quantile(value: Column | str, q: float) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(F.col(value) if isinstance(value, str) else value, F.lit(q))


def share(condition: Column) -> Column:
    """Percentage of rows."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100.0


def traffic_level(trips: Column, most: Column) -> Column:
    """log10 scale from 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(trips + 1) / F.log10(most + 1)))
