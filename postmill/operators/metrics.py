"""Latency summaries: nearest-rank percentiles, means, slowdown between the first and last window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.ranks import numbered


def nearest_rank(ordered: Column, fraction: float) -> Column:
    """The value at floor(n * fraction) of an ascending array, the last one at most; 0 of none."""
    n = F.size(ordered)
    return F.coalesce(F.get(ordered, F.least(n - 1, F.floor(n * fraction)).cast("int")), F.lit(0.0))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, least, median, p95, greatest per key; nulls count nowhere.

    Percentiles pick a rank among a key's values, which lie in as many tasks as they need.
    """
    ranked = numbered(df.select(*keys, value, F.col(value).isNull().alias("_null")), [*keys, "_null"], [F.col(value)])
    pick = lambda f: F.max(F.when(F.col("_k") == F.least(F.col("_n"), F.floor(F.col("_n") * f) + 1), F.col(value)))
    return ranked.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 1).alias("mean"), F.min(value).alias("least"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max(value).alias("greatest"))


def slowdown(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Means of the first and last max(3, n / 5) values and their ratio."""
    rows = numbered(df.select(*dict.fromkeys([*keys, *order, value])), keys, [F.col(c) for c in order])
    window = F.greatest(F.lit(3), F.floor(F.col("_n") / 5))
    rows = rows.groupBy(*keys).agg(F.avg(F.when(F.col("_k") <= window, F.col(value))).alias("first"), F.avg(F.when(F.col("_k") > F.col("_n") - window, F.col(value))).alias("last"))
    return rows.select(*keys, F.round("first", 4).alias("first_mean"), F.round("last", 4).alias("last_mean"), F.round(F.when(F.col("first") > 0, F.col("last") / F.col("first")).otherwise(F.lit(0.0)), 4).alias("ratio"))


def failures(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col("status") == "error").alias("failed"), F.min("n_lines").alias("least_lines"), F.max("n_lines").alias("most_lines"))
