"""What several operators share: tables, shared scratch space, folds, words, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import materialise, table, with_facts  # noqa: F401

#: The word bytes of the n-gram operators, after A-Z went to a-z: 0-9, a-z and every byte above 0x7F.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str | Column) -> Column:
    """True for rows whose label must not be learnt from: crc32(doc_id as text) mod 3 is 1."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def long_id() -> Column:
    """doc_id as a whole number; null where it is none."""
    return F.expr("try_cast(doc_id as bigint)").alias("doc_id")


def bounded_labels(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most per_class training rows of each class (doc_id, label): a documented bound on what a fit reads.

    Held-out rows and nulls are left out; of several labels for a document the largest holds. Rows are
    taken by a hash of doc_id, so every part of the corpus is as likely as any other.
    """
    rows = (
        labels.select(long_id(), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def sliced(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches in slices, so that what a task makes of long texts is handed on before the next ones are read."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered; forgets all when full, so that memory stays bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_list(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text whose A-Z were lower-cased."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def word_hashes(words: list[bytes], seen: WordHashes) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kgrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out + hashes[i : i + n]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return mix(out)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): component is the least node reached.

    Alternating large-star and small-star steps until a round changes nothing; every step is an
    aggregation with map-side combining and a join that spreads the neighbours of hubs. Only a count and a
    checksum come to the driver. Each round goes to the shared folder.
    """

    def marked(df: DataFrame) -> tuple[int, object]:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    least = F.min("v").alias("m"), F.count(F.lit(1)).alias("n")
    now = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, mark = None, marked(now)
    while mark != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(*least)
        large = with_facts(both, low, "u", "n", 2 * mark[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(*least)
        pairs = with_facts(large, low, "u", "n", 2 * mark[0])
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        now = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        before, mark = mark, marked(now)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
