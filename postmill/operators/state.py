"""A state table under keys: saves and clears as an append-only log, read as what holds last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill.operators.store import Store


def current(log: DataFrame, order: list[str]) -> DataFrame:
    """key, id, value of what is stored after a log (key, id, value, cleared) in the order of the named columns.

    A save replaces what its key holds; a clear only takes effect on the entry of its own id. So the last save of a
    key holds unless a later clear names its id; both come from aggregates, no row of a key is put in order.
    """
    return held(log, order).select("key", "id", "value")


def held(log: DataFrame, order: list[str]) -> DataFrame:
    """What current() returns, as the saves that it comes from: a log that says the same in one row a key."""
    at = F.struct(*order)
    saved = F.when(~F.coalesce("cleared", F.lit(False)), at)
    of_id = log.groupBy("key", "id").agg(F.max(saved).alias("saved"), F.max_by("value", saved).alias("value"), F.max(F.when(F.col("cleared"), at)).alias("gone"))
    last = of_id.where("saved is not null").groupBy("key").agg(F.max_by(F.struct("id", "value", "saved", "gone"), F.col("saved")).alias("l"))
    kept = last.where("l.gone is null or l.gone < l.saved")
    return kept.select("key", "l.id", "l.value", F.lit(False).alias("cleared"), *(F.col(f"l.saved.{c}").alias(c) for c in order))


def state_store(spark: SparkSession, path: str, schema: str | StructType, order: list[str]) -> Store:
    """A stored state table: append() takes saves and clears (the log's columns, in schema), read() gives held()."""
    return Store(spark, path, schema, lambda log: held(log, order).select(*log.columns))
