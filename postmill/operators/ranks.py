"""Row numbers within keys that stay spread over tasks, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import materialise


def numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds _k, the place of a row within its key from 1 on, and _n, how many rows the key has. Ties come in any order.

    Rows are dealt by ranges of key and order, so a large key takes several parts, each numbered by itself. What
    comes before a part is only looked up for keys of several parts: at most two rows a part, which are broadcast.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, "_tie").withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy(*keys, "_part")
    local = dealt.withColumn("_at", F.row_number().over(inside.orderBy(*order, "_tie")).cast("long")).withColumn("_m", F.count(F.lit(1)).over(inside))
    local = materialise(local.drop("_tie"), "numbered")
    by = Window.partitionBy(*keys)
    parts = local.where("_at = 1").select(*keys, "_part", "_m")
    parts = parts.withColumn("_whole", F.sum("_m").over(by)).withColumn("_before", F.sum("_m").over(by.orderBy("_part")) - F.col("_m"))
    several = F.broadcast(parts.where("_whole > _m").select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_part").alias("_of"), "_whole", "_before"))
    same = local["_part"] == several["_of"]
    for i, k in enumerate(keys):
        same &= local[k].eqNullSafe(several[f"_key{i}"])
    joined = local.join(several, same, "left")
    return joined.select(*rows.columns, (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("_k"), F.coalesce("_whole", "_m").alias("_n"))
