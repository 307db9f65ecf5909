"""Export planning: duplicate policy, free versioned names, history, file and vault sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill.functions.names import versioned_filename
from postmill.operators.ranks import numbered
from postmill.operators.store import Store


def policy_action(exists: Column, same_note: Column, policy: Column) -> Column:
    """write, skipped, versioned or an error, by what is stored under the name."""
    return (
        F.when(~exists, "write")
        .when(same_note & (policy == "skip"), "skipped")
        .when(same_note & (policy == "overwrite"), "write")
        .when(~same_note & (policy == "overwrite"), "error:NOTE_ID_MISMATCH")
        .otherwise("versioned")
    )


def plan_exports(incoming: DataFrame, vault: DataFrame) -> DataFrame:
    """Adds action to incoming (filename, note_id, policy) against vault (filename, note_id)."""
    stored = vault.select("filename", F.col("note_id").alias("stored_id"), F.lit(True).alias("stored"))
    rows = incoming.join(stored, "filename", "left")
    same = F.coalesce(F.col("stored_id") == F.col("note_id"), F.lit(False))
    return rows.withColumn("action", policy_action(F.coalesce("stored", F.lit(False)), same, F.col("policy"))).drop("stored", "stored_id")


def free_versions(wanted: DataFrame, vault: DataFrame, at: Column, most: int = 100) -> DataFrame:
    """filename -> first of `most` versioned names that isn't stored; an error if all are."""
    tries = wanted.select("filename").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("name", versioned_filename(F.col("filename"), at, F.col("k")))
    free = tries.join(vault.select(F.col("filename").alias("name")).distinct(), "name", "left_anti").groupBy("filename").agg(F.min("k").alias("k"))
    named = free.withColumn("name", versioned_filename(F.col("filename"), at, F.col("k")))
    return wanted.select("filename").distinct().join(named, "filename", "left").withColumn("error", F.when(F.col("k").isNull(), "VERSION_CONFLICT"))


def settle(incoming: DataFrame, vault: DataFrame, order: list[str], at: Column, most: int | None = 100) -> DataFrame:
    """Adds action, target and error to a batch (filename, note_id, policy and its order) against vault (filename, note_id).

    Notes of a batch are of different ids. Of those with one fresh name the first in the order takes it and the others
    find it there. Versions take the names that are free, one after the other, of at most `most` a name, of any number with None.
    """
    stored = vault.groupBy("filename").agg(F.min("note_id").alias("_id"), F.lit(True).alias("_stored"))
    rows = incoming.join(stored, "filename", "left").withColumn("_stored", F.coalesce("_stored", F.lit(False)))
    fresh = numbered(rows.where("not _stored"), ["filename"], [F.col(c) for c in order])
    met = (F.col("_k") > 1).alias("_stored")
    rows = rows.where("_stored").unionByName(fresh.select(*incoming.columns, F.lit(None).cast(rows.schema["_id"].dataType).alias("_id"), met))
    rows = rows.withColumn("action", policy_action(F.col("_stored"), F.coalesce(F.col("_id") == F.col("note_id"), F.lit(False)), F.col("policy"))).drop("_id", "_stored")
    versioned = numbered(rows.where("action = 'versioned'"), ["filename"], [F.col(c) for c in order]).drop("_n")
    # a stored version's number is read from its name, and the name made again from it has to be the same
    number = F.when(F.col("name").rlike(r"-[0-9]{6}-[0-9]{1,18}\.md\z"), F.regexp_extract("name", r"-([0-9]+)\.md\z", 1).cast("long")).otherwise(F.lit(1).cast("long"))
    there = vault.select(F.col("filename").alias("name")).distinct().withColumn("_k", number).withColumn("_stem", F.regexp_replace("name", r"_更新-[0-9]{8}-[0-9]{6}(-[0-9]+)?\.md\z", ""))
    there = there.where((F.col("name") == versioned_filename(F.col("_stem"), at, F.col("_k"))) & (F.col("_k") > 0))
    # before the taken t, of which i are lower, t - i - 1 numbers are free; a rank beyond them passes it
    taken = there.groupBy("_stem").agg(F.array_sort(F.collect_set("_k")).alias("_taken"))
    before = F.transform("_taken", lambda t, i: t - i - 1)
    versioned = versioned.withColumn("_stem", F.regexp_replace("filename", r"(?i)\.md\z", "")).join(taken, "_stem", "left")
    versioned = versioned.withColumn("_k", F.col("_k") + F.size(F.coalesce(F.filter(before, lambda b: b < F.col("_k")), F.array().cast("array<long>"))))
    if most is not None:
        versioned = versioned.withColumn("_k", F.when(F.col("_k") <= most, F.col("_k")))
    versioned = versioned.withColumn("target", F.when(F.col("_k").isNotNull(), versioned_filename(F.col("filename"), at, F.col("_k")))).withColumn("error", F.when(F.col("_k").isNull(), "VERSION_CONFLICT")).drop("_k", "_taken", "_stem")
    others = rows.where("action <> 'versioned'").withColumn("target", F.when(~F.col("action").startswith("error:"), F.col("filename"))).withColumn("error", F.regexp_extract("action", "^error:(.*)$", 1))
    others = others.withColumn("error", F.nullif("error", F.lit("")))
    return versioned.unionByName(others).withColumn("action", F.when(F.col("error").isNull(), F.col("action")))


def upsert_history(history: DataFrame, keys: list[str], order: list[Column], most: int = 200) -> DataFrame:
    """The `most` latest rows, one per key. order: latest first.

    Latest rows per key come from an aggregate, the cut from a top-k; no window over all rows.
    """
    rank = F.struct(*order)
    rows = history.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in history.columns if c not in keys]), rank).alias("r"), F.min(rank).alias("_o"))
    return rows.orderBy("_o", *keys).limit(most).select(*keys, "r.*")


def history_store(spark: SparkSession, path: str, schema: str | StructType, keys: list[str], order: list[Column], most: int = 200) -> Store:
    """A stored history: append() takes finished exports, read() gives the `most` latest, one per key, as upsert_history() does."""
    return Store(spark, path, schema, lambda rows: upsert_history(rows, keys, order, most).select(*rows.columns))


def flag_processed(rows: DataFrame, history: DataFrame, key: str = "note_id", output: str | None = None) -> DataFrame:
    done = history if output is None else history.where(F.col("output") == output)
    return rows.join(done.select(key, F.lit(True).alias("_done")).distinct(), key, "left").withColumn("processed", F.coalesce("_done", F.lit(False))).drop("_done")


def unique_names(rows: DataFrame, order: list[Column]) -> DataFrame:
    """File names of one batch made unique: the second and later of a name get ` (n)` before .md."""
    later = F.concat(F.regexp_replace("filename", r"(?i)\.md\z", ""), F.lit(" ("), (F.col("_k") - 1).cast("string"), F.lit(").md"))
    return numbered(rows, ["filename"], order).withColumn("target", F.when(F.col("_k") == 1, F.col("filename")).otherwise(later)).drop("_k", "_n")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes target -> markdown under a folder that all executors share; returns target, bytes, error.

    A file is first written beside its place and then renamed, so a repeated task leaves whole files.
    """

    def put(batches):
        import os
        import uuid

        import pyarrow as pa

        for batch in batches:
            names, sizes, errors = batch.column("target").to_pylist(), [], []
            for name, text in zip(names, batch.column("markdown").to_pylist(), strict=True):
                data, error = (text or "").encode(), None
                try:
                    path = os.path.join(folder, name)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                        f.write(data)
                    os.replace(part, path)
                except OSError as e:
                    error = type(e).__name__
                sizes.append(len(data))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["target", "bytes", "error"])

    return rows.select("target", "markdown").mapInArrow(put, "target string, bytes long, error string")
