"""Session construction and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that with_facts() broadcasts at most.
HUBS = 100_000


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="postmill-"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="postmill-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is put there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/postmill/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back; the files go when the driver ends."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of about that many rows, for rows that are small to move and long to work on; a file of few bytes is
    one task otherwise, however many rows it has."""
    return df.repartition(max(1, -(-df.count() // rows)))


def with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, keep: bool = False) -> DataFrame:
    """rows joined with facts, which has one row a key; `count` says how many rows have that key, `total` how many there are.
    With keep, rows without facts stay.

    A key of more rows than total / HUBS would gather in one task, so its facts are broadcast; there are at
    most HUBS such keys. Their rows take part in the shuffle under a key of their own, which spreads them.
    """
    most = max(256, total // HUBS)
    names = [c for c in facts.columns if c not in (key, count)]
    hot = F.broadcast(facts.where(F.col(count) > most).select(F.col(key), F.struct(*names).alias("_hot")))
    cold = facts.where(F.col(count) <= most).select(F.col(key).alias("_key"), F.struct(*names).alias("_cold"))
    spread = F.xxhash64(*rows.columns).cast(rows.schema[key].dataType)
    rows = rows.join(hot, key, "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    rows = rows.join(cold, "_key", "left").withColumn("_facts", F.coalesce("_hot", "_cold"))
    rows = rows if keep else rows.where("_facts is not null")
    return rows.select(*(c for c in rows.columns if not c.startswith("_")), "_facts.*")
