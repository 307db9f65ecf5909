"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns
of documents; the last returns pieces with their token ids, sequence and place. Every stage's result is
written as Parquet in the session's shared folder and read again, so that a lost executor costs
no more than the stage it was in.

1. toxicity: fitted on labels, scored on whole texts; rows that it rejects go, whatever their doc_id.
2. near duplicates: of each class of the n-gram Jaccard join the rows of the least doc_id stay, each different
   text of it once. A row without a doc_id has a number made from its text, higher than any that is used,
   so that of null ids with one text one stays, and none beside a like text that has a doc_id.
3. decontamination: rows in which a benchmark window occurs go, whatever their doc_id.
4. secrets: each secret is replaced by a label of its kind; the document stays.
5. packing: all that is left, in sequences of 1024 ids. The result holds the ids themselves, so it can be
   written and trained on without the tables between the stages, which go when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import materialise, table
from postmill.llm.decontaminate import without_contaminated
from postmill.llm.jaccard import jaccard_classes
from postmill.llm.packing import best_fit
from postmill.llm.secrets import redact_secrets
from postmill.llm.toxicity import without_toxic


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made_up = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), made_up))
    classes = materialise(jaccard_classes(keyed.select(F.col("_id").alias("doc_id"), "text")), "classes")
    going = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = keyed.join(going.hint("merge"), "_id", "left_anti")  # the same plan at every size
    repeated = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"))
    if repeated.head(1):  # of rows under one number each text stays once
        kept = kept.dropDuplicates(["_id", "text"])
    return kept.select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit(docs, with_ids=True)


STAGES = [("toxicity", remove_toxic), ("near_duplicates", remove_near_duplicates), ("decontamination", remove_contaminated), ("secrets", hide_secrets), ("packing", pack_documents)]
#: SQL cannot express the first stage's classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
