"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of the slots of a table whose size is a prime: offset + skip * j,
with offset and skip from hashes of its name. Shards take turns, each claiming its next preferred
free slot, until the table is full. Shards' shares differ by one slot at most, and few slots change
hands when a shard leaves. The table has a fixed size and is broadcast; placing a row is one hash
and one lookup, without a shuffle, whatever the keys' frequencies.

Cases: a null key is hashed as the empty text; equal keys share a shard; texts aren't read; other
columns are left out, whatever their names; the key's own must not be `slot` or `shard`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import long_id, table

SLOTS, SHARDS = 16_411, 64


def number(text: str) -> int:
    """The first 60 bits of a text's MD5, which Spark and DuckDB can both compute."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's number in each slot."""
    if not shards or len(shards) > slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime no smaller than the number of shards, of which there is one at least")
    offset = [number(f"offset/{s}") % slots for s in shards]
    skip = [number(f"skip/{s}") % (slots - 1) + 1 for s in shards]
    owner, turn = [-1] * slots, [0] * len(shards)
    free = slots
    while True:
        for i in range(len(shards)):
            at = (offset[i] + skip[i] * turn[i]) % slots
            while owner[at] >= 0:
                turn[i] += 1
                at = (at + skip[i]) % slots
            owner[at] = i
            turn[i] += 1
            free -= 1
            if not free:
                return owner


def names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot(key: str | Column, slots: int = SLOTS) -> Column:
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """key, slot and shard (the number of the shard that holds the slot) of every row."""
    if key in ("slot", "shard"):
        raise ValueError("the key must not be named slot or shard")
    spark = df.sparkSession
    listed = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    lookup = spark.range(1).select(F.posexplode(listed).alias("slot", "shard")).select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))
    return df.select(F.col(key), slot(key, slots).alias("slot")).join(F.broadcast(lookup), "slot").select(key, "slot", "shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(long_id())
    return place(docs, "doc_id", names(SHARDS)).select("doc_id", "slot", "shard")


def oracle() -> str:
    return f"""
with t as (select unnest(range({SLOTS})) as slot, unnest([{", ".join(map(str, fill(names(SHARDS))))}]) as shard),
d as (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) % {SLOTS} as slot from documents)
select doc_id, d.slot, shard from d join t using (slot)
"""
