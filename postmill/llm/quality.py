"""Quality classifier: Naive Bayes support vectors.

A text becomes the set of its n-grams: single words, and runs of one to three word forms (case
pattern, digits, other characters as they stand, a mark for a word that repeats the one before).
Each n-gram present is scaled by the log ratio of its smoothed shares in good and bad training
documents, rows are scaled to length one, and a linear hinge-loss model is fitted to them by dual
coordinate descent. Its weights are interpolated with their mean, as usual for this method, and a
logistic curve through training margins turns margins into scores.

The fit reads at most `per_class` labelled documents of each class (the documented bound); scoring
reads every whole text. Features live in `width` hashed columns, so the broadcast model has a fixed
size. Cases: null and empty texts have no n-grams and get the score of the bias alone; without
training rows of both classes every score is 0.5; repeated rows each give a row; a null doc_id is
scored and not held out; labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import MULTIPLIER, bounded_labels, held_out, long_id, mix, table
from postmill.llm.linear import dual_coordinate_descent, logistic

WIDTH = 1 << 18
FORM = re.compile(r"[A-ZÀ-ÖØ-Þ]+|[a-zà-öø-ÿß]+|[0-9]+|\s+")


class Words(dict):
    """word -> (hash of its lower-case letters, hash of its form); forgets all when full."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        form = FORM.sub(lambda m: {True: "A" if len(m[0]) == 1 else "AA", False: "a"}[m[0].isupper()] if m[0].isalpha() else "0", word)[:12]
        value = self[word] = (xxhash.xxh3_64_intdigest(word.lower().strip(".,;:!?")), xxhash.xxh3_64_intdigest("form " + form))
        return value


REPEATED = 0x5EED


def ngrams(text: str | None, seen: Words) -> np.ndarray:
    """Ascending hashed columns of the n-grams that a text has."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64)
    both = np.array([seen[w] for w in words], np.uint64).reshape(-1, 2)
    word, form = both[:, 0], both[:, 1].copy()
    form[1:][word[1:] == word[:-1]] = np.uint64(REPEATED)
    grams = [word, mix(form)]
    for k in (2, 3):
        if len(form) >= k:
            run = form[: len(form) - k + 1].copy()
            for i in range(1, k):
                run = run * MULTIPLIER + form[i : len(form) - k + 1 + i]
            grams.append(mix(run + np.uint64(k)))
    flags = np.zeros(WIDTH, bool)
    flags[(np.concatenate(grams) & np.uint64(WIDTH - 1)).astype(np.int64)] = True
    return np.nonzero(flags)[0]


def fit(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0, share: float = 0.75, cost: float = 1.0) -> dict:
    """weights (scaled by the log-count ratios), ratios, bias, slope and offset of the model."""
    pos, neg = np.full(WIDTH, smoothing), np.full(WIDTH, smoothing)
    for cols, label in zip(rows, y, strict=True):
        (pos if label else neg)[cols] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    scaled = [(cols, (ratio[cols] / max(1e-9, float(np.linalg.norm(ratio[cols])))).astype(np.float32)) for cols in rows]
    sign, count = np.where(y == 1, 1.0, -1.0), np.bincount(y, minlength=2)
    w, bias = dual_coordinate_descent(scaled, sign, WIDTH, cost * len(y) / (2.0 * count[y]))
    w = share * w + (1 - share) * np.abs(w).mean()
    margins = np.array([float(w[c] @ v) + bias for c, v in scaled])
    slope, offset = logistic(margins, y.astype(float), len(y) / (2.0 * count[y]))
    return {"weight": (w * ratio).astype(np.float32), "ratio": ratio.astype(np.float32), "bias": bias, "slope": slope, "offset": offset}


def margin(cols: np.ndarray, model: dict) -> float:
    """The hinge-loss model's decision on a text's n-grams, scaled by ratios and to length one."""
    norm = float(np.linalg.norm(model["ratio"][cols].astype(float)))
    return float(model["weight"][cols].astype(float).sum()) / max(1e-9, norm) + model["bias"]


def score_of(decision: float, model: dict) -> float:
    return float(1 / (1 + np.exp(-np.clip(model["slope"] * decision + model["offset"], -30, 30))))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    rows = docs.select(long_id(), F.col("text").cast("string").alias("text"))

    def featurise(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = Words()
        for batch in batches:
            cols = [ngrams(x.as_py(), seen).astype(np.int32).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(cols, pa.binary())], ["doc_id", "label", "cols"])

    train = rows.join(F.broadcast(bounded_labels(labels, "quality", per_class)), "doc_id").select("doc_id", "label", "text")
    got = sorted((r["doc_id"], r["label"], bytes(r["cols"])) for r in train.mapInArrow(featurise, "doc_id long, label int, cols binary").collect())
    y = np.array([label for _, label, _ in got], np.int64)
    model = spark.sparkContext.broadcast(fit([np.frombuffer(c, np.int32) for *_, c in got], y) if len(set(y.tolist())) == 2 else None)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, m = Words(), model.value
        for batch in batches:
            out = [0.5 if m is None else score_of(margin(ngrams(text.as_py(), seen), m), m) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
