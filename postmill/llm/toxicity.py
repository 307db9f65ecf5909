"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The sentences of a text are bags of units: words in lower case without other characters than letters and
digits, the parts of three letters or more of a word that such characters divide (`you,idiot`), and runs of
three or more single characters joined to one word, so that `i.d.i.o.t` and `i d i o t` are the unit `idiot`.
Two units are compared by the normalised subsequence kernel of length three: every three characters in order
count, with a decay for each place that they span, so gaps and inserted characters lower the value but little.
A kernel over whole sentences would count subsequences across words, which means nothing here; a sentence's
decision is that of its units instead. Landmarks are units that tell toxic from clean training sentences,
unlike one another, some of them with a letter put inside, and ordinary ones; the kernel with them, through the
inverse root of their own kernel matrix, is the Nyström feature map of a linear hinge-loss model.

A text's score is a logistic function of a soft maximum over its three highest units (one that stands in it
twice counts twice; the model reads no more than three), so that one plain insult suffices and doubtful ones
support each other. Labels of documents reach their units so: a toxic document's highest unit among those that
clean ones hardly have, and units found in toxic documents almost alone, are positive examples, as are these
with a letter put inside; all units of clean documents are negative ones. Units weigh as many times as
training documents have them, up to HEAVIEST. The curve is fitted to the training documents and, at VIRTUAL of
their weight, to clean ones with one such altered unit put in. Of training documents that are likely copies of
one another (three least hashes of long units) one is taken. As the kernel's features are explicit (three
character classes), weights and landmarks fold into one table of 64^3 numbers, which is all that is broadcast.

The fit reads at most `per_class` labelled documents of each class (the documented bound); scoring
reads every whole text. Cases: null, empty and wordless texts have the score of a unit without
features; without training rows of both classes every score is 0.5; repeated rows each give a row;
a null doc_id is scored and not held out; labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import random
import re
import string
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import bounded_labels, held_out, long_id, sliced, table
from postmill.llm.linear import dense_descent, logistic, times

DECAY, SPAN, CLASSES = 0.6, 7, 64
START, END = 37, 38
KEEP = re.compile(r"[\W_]+")
SINGLES = re.compile(r"(?:(?<!\S)\w(?:\s+|$)){3,}")
LONGEST = 40
HIGHEST = 3
SHARPNESS = (0.5, 1.0, 2.0, 4.0)
LETTERS = string.ascii_lowercase
HEAVIEST, VIRTUAL = 20, 0.15
#: Character class by code point below 128; others share the classes from 39 on.
ASCII = np.array([ord(chr(c).lower()) - 96 if chr(c).isalpha() else 27 + c - 48 if 48 <= c <= 57 else 39 + c % 25 for c in range(128)], np.int32)


def units(text: str) -> Counter[str]:
    """Words as they stand in a text, lower-cased, with joined runs of single characters; how often each."""
    text = text.lower()
    out = Counter(text.split())
    out.update("".join(m[0].split()) for m in SINGLES.finditer(text))
    return out


def pieces(word: str) -> list[str]:
    """A unit without other characters, and its parts of three or more; one of over LONGEST in pieces that overlap by half."""
    parts = [p for p in KEEP.split(word) if p]
    own = ["".join(parts), *(p for p in parts if len(p) >= 3)]
    return list(dict.fromkeys(w[i : i + LONGEST] for w in own if w for i in range(0, max(1, len(w) - LONGEST // 2 if len(w) > LONGEST else 1), LONGEST // 2)))


@lru_cache(maxsize=64)
def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All i < j < k below n with k - i at most SPAN, and the decay of each."""
    found = np.array([(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN + 1)) for j in range(i + 1, k)], np.int32).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2], (DECAY ** (found[:, 2] - found[:, 0] + 1)).astype(np.float64)


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of word: numbers of the words, codes of their subsequences (a row each), decays."""
    by: dict[int, list[int]] = defaultdict(list)
    for i, word in enumerate(words):
        by[len(word)].append(i)
    for n, numbers in by.items():
        if n == 0:
            continue
        i, j, k, decay = places(n + 2)
        step = max(1, 500_000 // max(1, len(i)))
        for at in range(0, len(numbers), step):
            part = numbers[at : at + step]
            chars = np.frombuffer("".join(words[x] for x in part).encode("utf-32-le"), np.uint32).reshape(len(part), n).astype(np.int64)
            classes = np.where(chars < 128, ASCII[np.minimum(chars, 127)], 39 + chars % 25).astype(np.int32)
            classes = np.hstack([np.full((len(part), 1), START, np.int32), classes, np.full((len(part), 1), END, np.int32)])
            yield np.array(part), (classes[:, i] * CLASSES + classes[:, j]) * CLASSES + classes[:, k], decay


def norms(codes: np.ndarray, decay: np.ndarray) -> np.ndarray:
    rows = len(codes)
    keys, inverse = np.unique((np.arange(rows, dtype=np.int64)[:, None] * CLASSES**3 + codes).ravel(), return_inverse=True)
    value = np.bincount(inverse, weights=np.tile(decay, rows), minlength=len(keys))
    return np.sqrt(np.bincount(keys // CLASSES**3, weights=value * value, minlength=rows))


def decide(words: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """Decisions of units under the folded table of weights."""
    out = np.full(len(words), bias)
    for numbers, codes, decay in subsequences(words):
        if codes.shape[1]:
            out[numbers] += (weight[codes] @ decay) / np.maximum(1e-12, norms(codes, decay))
    return out


def feature_rows(words: list[str], column: np.ndarray, width: int) -> np.ndarray:
    """Normalised explicit features of units, at the columns that landmarks have."""
    out = np.zeros((len(words), width + 1), np.float32)
    for numbers, codes, decay in subsequences(words):
        if codes.shape[1]:
            size = np.maximum(1e-12, norms(codes, decay))
            np.add.at(out, (np.repeat(numbers, codes.shape[1]), column[codes].ravel()), (decay[None, :] / size[:, None]).ravel())
    return out[:, :width]


def projected(words: list[str], column: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Nyström features of units: normalised explicit features times table, whose last row is for characters that no landmark has.

    They stand in a temporary file, mapped, since they are by far the most that a fit holds."""
    with tempfile.TemporaryFile() as file:  # the mapping keeps it
        out = np.asarray(np.memmap(file, np.float16, "w+", shape=(max(1, len(words)), table.shape[1])))[: len(words)]
    for numbers, codes, decay in subsequences(words):
        for at in range(0, len(numbers), 1000) if codes.shape[1] else ():
            part = codes[at : at + 1000]
            rows, found = column[part], np.zeros((len(part), table.shape[1]), np.float32)
            for k, weight in enumerate(decay.astype(np.float32)):
                found += table[rows[:, k]] * weight
            out[numbers[at : at + 1000]] = found / np.maximum(1e-12, norms(part, decay))[:, None]
    return out


def landmarks(every: list[str], pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, telling: int, ordinary: int) -> list[str]:
    """Units with the largest weighted log ratio that are unlike those before them, then common clean ones."""
    ratio = (np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))) * np.sqrt(pos)
    fine = np.nonzero((pos >= 2) & (ratio > 0) & (neg * n_pos < 0.03 * pos * n_neg))[0].tolist()
    ranked = [every[i] for i in sorted(fine, key=lambda i: (-ratio[i], every[i])) if len(every[i]) >= 3][: 4 * telling]
    codes = sorted({int(c) for _, found, _ in subsequences(ranked) for c in np.unique(found)})
    column = np.full(CLASSES**3, len(codes), np.int64)
    column[codes] = np.arange(len(codes))
    rows = feature_rows(ranked, column, len(codes))
    chosen: list[int] = []
    for i in range(len(ranked)):
        if len(chosen) < telling and (not chosen or float((rows[chosen] @ rows[i]).max()) < 0.75):
            chosen.append(i)
    common = [every[i] for i in sorted(np.nonzero(neg)[0].tolist(), key=lambda i: (-neg[i], every[i]))[: 10 * ordinary] if len(every[i]) >= 3]
    return [ranked[i] for i in chosen] + common[: 8 * ordinary : 8]


def likely_copy(own: list[str], seen: set) -> bool:
    """Whether the three least hashes of a document's long units came before, under one of three salts."""
    import xxhash

    long = [u for u in own if len(u) >= 8]
    least = [(salt, *sorted(xxhash.xxh3_64_intdigest(u, salt) for u in long)[:3]) for salt in range(3)] if len(long) >= 4 else []
    copy = any(x in seen for x in least)
    seen.update(least)
    return copy


def insertions(unit: str, n: int) -> list[str]:
    """Up to n virtual examples of a unit: a letter put inside, the places taking turns, the letters drawn by the unit."""
    draw = random.Random(unit)
    return list(dict.fromkeys(unit[:at] + draw.choice(LETTERS) + unit[at:] for at in (1 + i % (len(unit) - 1) for i in range(n)))) if len(unit) > 3 else []


def evidence(counted: Iterable[tuple[float, int]], bias: float) -> list[float]:
    """The decisions of a text's HIGHEST units, each as often as it stands there; none is less than -1 or the bias."""
    floor = max(-1.0, bias)
    out: list[float] = []
    for decision, times in sorted(((d, n) for d, n in counted if d > floor), reverse=True)[:HIGHEST]:
        out += [decision] * times
    return (out + [floor] * HIGHEST)[:HIGHEST]


def soft_maximum(tops: np.ndarray, sharp: float) -> np.ndarray:
    """Of each row: near its largest value, more where others come near that."""
    return np.logaddexp.reduce(sharp * tops, axis=1) / sharp


class Examples:
    """Training documents as numbered units: which each has, how often, and in how many documents of each class a unit is."""

    def __init__(self, examples: Iterable[tuple[int, list[str]]]) -> None:
        number: dict[str, int] = {}
        labels, self.units, self.times, seen = [], [], [], set()
        for label, own in examples:
            counts = Counter(p for u in own for p in pieces(u))
            units_of = sorted(counts)
            if not likely_copy(units_of, seen):  # copies would make chance words look telling
                labels.append(label)
                self.units.append(np.array([number.setdefault(u, len(number)) for u in units_of], np.int32))
                self.times.append(np.array([min(counts[u], HIGHEST) for u in units_of], np.int8))
        self.every, self.labels = list(number), np.array(labels, np.int64)
        self.n_pos = int(self.labels.sum())
        self.n_neg = len(labels) - self.n_pos
        self.pos, self.neg = (np.bincount(np.concatenate([np.empty(0, np.int32), *(u for u, y in zip(self.units, labels, strict=True) if y == k)]), minlength=len(number)) for k in (1, 0))

    def telltale(self) -> dict[int, int]:
        """Units of toxic documents almost alone, in so many that chance would hardly make one such unit; with their documents."""
        least = max(3.0, np.log(len(self.every)) / np.log((self.n_pos + self.n_neg) / self.n_pos))
        return {int(i): int(self.pos[i]) for i in np.nonzero((self.pos >= least) & (50 * self.neg * self.n_pos <= self.pos * self.n_neg))[0]}


def nystroem(marks: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Row of each subsequence's code in the table, the table (explicit to Nyström features) and the codes that have one."""
    used = sorted({int(c) for _, found, _ in subsequences(marks) for c in np.unique(found)})
    column = np.full(CLASSES**3, len(used), np.int64)
    column[used] = np.arange(len(used))
    own = feature_rows(marks, column, len(used)).astype(np.float64)
    value, vector = np.linalg.eigh(own @ own.T)
    fine = value > 1e-4
    table = own.T @ (vector[:, fine] / np.sqrt(value[fine]))
    return column, np.vstack([table, np.zeros((1, table.shape[1]))]), used


def fit(examples: Iterable[tuple[int, list[str]]], telling: int = 96, ordinary: int = 32, rounds: int = 3, inserted: int = 24, cost: float = 2.0, weight: float = 4000.0) -> dict:
    """The folded table, bias, sharpness, slope and offset. examples: (label, units with repeats)."""
    known = Examples(examples)
    every, pos, neg, n_pos, n_neg, y_docs = known.every, known.pos, known.neg, known.n_pos, known.n_neg, known.labels
    marks = landmarks(every, pos, neg, n_pos, n_neg, telling, ordinary) if every else []
    if not marks:
        return {"table": np.zeros(CLASSES**3, np.float32), "bias": 0.0, "sharp": 1.0, "slope": 1.0, "offset": 0.0, "landmarks": []}
    telltale, clean = known.telltale(), np.nonzero(neg)[0]
    common = {every[i] for i in clean}
    altered = {i: own for i in telltale if (own := [v for v in insertions(every[i], inserted) if v not in common])}
    virtual = {v: min(HEAVIEST, telltale[i]) / len(own) for i, own in altered.items() for v in own}
    marks += [v for m in marks[: telling // 4] for v in insertions(m, 4) if v in virtual]
    column, table, used = nystroem(marks)
    x = projected([*every, *virtual], column, table.astype(np.float32))  # a row per unit, then one per virtual example
    n, put_in = len(every), np.arange(len(every), len(every) + len(virtual))
    belief = np.log((pos + 0.1) / (n_pos + 1)) - np.log((neg + 0.1) / (n_neg + 1))
    witness = neg * n_pos <= 0.1 * pos * n_neg  # a unit that clean documents have as well can't be why one is toxic
    bags = [u[witness[u]] for u, label in zip(known.units, y_docs, strict=True) if label and witness[u].any()]
    for _ in range(rounds):
        tops = Counter(int(u[np.argmax(belief[u])]) for u in bags) | Counter(telltale)
        rows = np.r_[list(tops), put_in, clean].astype(np.int64)
        y = np.r_[np.ones(len(tops) + len(virtual)), -np.ones(len(clean))]
        toxic = np.r_[np.minimum(np.array(list(tops.values()), float), HEAVIEST), np.array(list(virtual.values()), float)]
        costs = cost * np.r_[toxic * weight / max(1.0, toxic.sum()), np.minimum(neg[clean], HEAVIEST)]
        w, bias = dense_descent(x, rows, y, costs, rounds=30)
        decided = times(x, w) + bias
        belief = decided[:n]
    folded = np.zeros(CLASSES**3)
    folded[used] = table[:-1] @ w
    tops_of = np.array([evidence(zip(belief[u].tolist(), n.tolist(), strict=True), bias) for u, n in zip(known.units, known.times, strict=True)])
    y_all, share = y_docs.astype(float), len(y_docs) / (2.0 * np.where(y_docs == 1, n_pos, n_neg))
    if virtual:
        plain, put = tops_of[y_docs == 0], decided[put_in]
        mixed = np.hstack([plain, put[np.arange(len(plain)) % len(put)][:, None]])
        tops_of = np.vstack([tops_of, -np.sort(-mixed, axis=1)[:, :HIGHEST]])
        y_all, share = np.r_[y_all, np.ones(len(plain))], np.r_[share, np.full(len(plain), VIRTUAL * len(y_docs) / 2.0 / len(plain))]
    fits = []
    for sharp in SHARPNESS:
        margins = soft_maximum(tops_of, sharp)
        slope, offset = logistic(margins, y_all, share)
        fits.append((float(np.sum(share * np.logaddexp(0, -(2 * y_all - 1) * (slope * margins + offset)))), sharp, slope, offset))
    _, sharp, slope, offset = min(fits)
    return {"table": folded.astype(np.float32), "bias": float(bias), "sharp": sharp, "slope": slope, "offset": offset, "landmarks": marks}


class Decisions(dict):
    """word as it stands -> decision, remembered up to a limit."""

    LIMIT = 400_000

    def __init__(self, model: dict) -> None:
        super().__init__()
        self.weight, self.bias = model["table"].astype(np.float64), model["bias"]

    def learn(self, words: Iterable[str]) -> None:
        words = list(words)
        split = [pieces(w) for w in words]
        found, at = decide([p for parts in split for p in parts], self.weight, self.bias).tolist(), 0
        for word, parts in zip(words, split, strict=True):
            self[word] = max(found[at : at + len(parts)], default=self.bias)
            at += len(parts)


def scores(texts: Iterable[str | None], model: dict, seen: Decisions) -> list[float]:
    """A score for each text; decisions of its words are looked up in seen, or made and put there."""
    own = [units(x or "") for x in texts]
    new = set().union(*own)
    if len(seen) + len(new) > seen.LIMIT:
        seen.clear()
    seen.learn(new.difference(seen))
    tops = np.array([evidence(zip(map(seen.__getitem__, us), us.values(), strict=True), model["bias"]) for us in own])
    return (1 / (1 + np.exp(-np.clip(model["slope"] * soft_maximum(tops, model["sharp"]) + model["offset"], -30, 30)))).tolist()


def train(docs: DataFrame, labels: DataFrame, per_class: int) -> dict | None:
    """The model of at most per_class labelled documents a class; None unless there are both classes."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = [" ".join(u for u, n in sorted(units(x.as_py() or "").items()) for _ in range(min(n, HIGHEST))) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(lists, pa.string())], ["doc_id", "label", "units"])

    rows = docs.select(long_id(), F.col("text").cast("string").alias("text")).join(F.broadcast(bounded_labels(labels, "toxic", per_class)), "doc_id").select("doc_id", "label", "text")
    got = sorted(((r[0], r[1], r[2]) for r in rows.mapInArrow(counted, "doc_id long, label int, units string").collect()), reverse=True)
    both = len({label for _, label, _ in got}) == 2
    taken = (got.pop() for _ in range(len(got)))  # each text goes once it was read
    return fit((label, own.split(" ")) for _, label, own in taken) if both else None


def with_score(rows: DataFrame, model: dict | None) -> DataFrame:
    """row and its score; rows has one struct column `row` with a text among its fields."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        seen = Decisions(m) if m else None
        for batch in sliced(batches):
            texts = batch.column("row").field("text").to_pylist()
            out = scores(texts, m, seen) if m else [0.5] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.float64())], ["row", "score"])

    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, per_class)
    scored = with_score(docs.select(F.struct(long_id(), F.col("text").cast("string").alias("text")).alias("row")), model)
    return scored.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.7) -> DataFrame:
    """The documents that aren't predicted toxic, each row by its own score; all their columns travel with it."""
    scored = with_score(docs.select(F.struct(*docs.columns).alias("row")), train(docs, labels, per_class))
    return scored.where(F.col("score") < threshold).select("row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
