"""Periodic runs of words: stretches that repeat themselves with a period at least three times.

A run of period q and length L makes L - q places whose word is that q words on. So the places of every lag
are counted first, and only lags with enough of them are looked at:

* heavy words, more frequent than sqrt(n log n): the autocorrelation of their indicators, by one Fourier transform
  a word and one back for their sum; a count is a whole number far below 2^50, so rounding makes it exact.
* light words: differences of the places of each word, first those of neighbours, then of next ones, and so on.

Lags are taken in rising order. A run of period p accounts for L - q places of every multiple q of p, and none of
these can be part of a run of smallest period q (two such runs overlap in fewer than q words), so they are taken off the
counts: a text that is one word repeated has one lag to look at, not n / 3.

A lag that still has max(24, 3 q) - q places gets an island scan: the places at a stride of a sixteenth of that
length, then every place around strides that all match. An island is a run unless a divisor of q is a period of it.
Altogether a text of n words takes about n^1.5 steps, whatever it holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import sliced, table

#: Samples that an island must have in a row before all its places are read.
SAMPLES = 16
SPACE = r"[\x20\x09-\x0D]+"


def heavy_lags(codes: np.ndarray, heavy: np.ndarray, most: int) -> np.ndarray:
    """For lags 0..most: at how many places a heavy word stands again that many words on."""
    size = 1 << (len(codes) + most).bit_length()
    power = np.zeros(size // 2 + 1)
    for word in heavy:
        spectrum = np.fft.rfft(codes == word, size)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def light_lags(places: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """The same for light words. places: by word, rising; left: how many places of its word follow each."""
    counts, now, ahead = np.zeros(most + 1, np.int64), np.nonzero(left)[0], 1
    while len(now):
        lag = places[now + ahead] - places[now]
        near = lag <= most
        counts += np.bincount(lag[near], minlength=most + 1)
        ahead += 1
        now = now[near & (left[now] >= ahead)]
    return counts


def lag_counts(codes: np.ndarray, most: int) -> np.ndarray:
    """For lags 0..most: at how many places the word that many words on is the same. Entry 0 means nothing."""
    n = len(codes)
    often = np.bincount(codes)
    heavy = np.nonzero(often > math.sqrt(n * math.log2(n + 1)))[0]
    order = np.argsort(codes, kind="stable")
    last = np.cumsum(often)[codes[order]] - 1
    left = last - np.arange(n)
    left[np.isin(codes[order], heavy)] = 0
    counts = light_lags(order, left, most)
    return counts + heavy_lags(codes, heavy, most) if len(heavy) else counts


def stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and end of stretches of at least so many true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= least
    return list(zip(begins[long].tolist(), ends[long].tolist(), strict=True))


def islands(codes: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """Longest stretches of places whose word stands again `lag` words on, of at least `least` places."""
    n, stride = len(codes) - lag, max(1, least // SAMPLES)
    if stride == 1:
        return stretches(codes[:n] == codes[lag:], least)
    sampled = codes[:n:stride] == codes[lag::stride]
    found = []
    for begin, end in stretches(sampled, least // stride):
        low, high = max(0, (begin - 1) * stride + 1), min(n, end * stride)
        found += [(low + a, low + b) for a, b in stretches(codes[low:high] == codes[low + lag : high + lag], least)]
    return found


def primes_of(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] if q > 1 else out


def find_runs(codes: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's word numbers, by start, then period.

    A run has at least `least` words and `times` (3 or more) periods; period is its smallest one, and the words next to it break it.
    """
    if times < 3:
        raise ValueError("fewer than three periods")
    n = len(codes)
    if n < max(least, times):
        return []
    most = n // times
    counts, lags = lag_counts(codes, most), np.arange(most + 1)
    need = np.maximum(least, times * lags) - lags
    runs = []
    for q in (np.flatnonzero(counts[1:] >= need[1:]) + 1).tolist():
        if counts[q] < need[q]:
            continue
        for begin, end in islands(codes, q, int(need[q])):
            end += q
            if any(np.array_equal(codes[begin : end - q // p], codes[begin + q // p : end]) for p in primes_of(q)):
                continue
            runs.append((begin, end - begin, q))
            multiples = np.arange(2 * q, min(end - begin, most + 1), q)
            counts[multiples] -= end - begin - multiples
    return sorted(runs, key=lambda run: (run[0], run[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods; of equal ones the first, then that of the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those that a run repeats."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, runs (array of start, length, period by start, then period), best (of these; null without runs) and
    collapsed (the words that no run repeats, joined by one space) of every document.

    Words are what ASCII white space separates; a null text has none. Rows repeat as they come, and a null doc_id is
    no matter. A text is read whole, however long: the largest array has some four entries a word. An empty table
    gives an empty result. Other columns aren't read.
    """

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in sliced(batches):
            found, best, texts = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                numbers: dict[bytes, int] = {}
                codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                runs = find_runs(codes, least, times)
                if runs:
                    keep = kept_words(len(words), runs)
                    words = [words[i] for i in np.flatnonzero(keep)]
                top = strongest(runs)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                texts.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(run)), pa.array(best, run), pa.array(texts, pa.string())], ["doc_id", "runs", "best", "collapsed"])

    one = "struct<start:bigint,length:bigint,period:bigint>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, runs array<{one}>, best {one}, collapsed string")


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, chosen by doc_id, the words from some place on repeat a stretch of themselves."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text").cast("string"), SPACE), lambda w: w != "")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    moved = F.expr("transform(words, (w, i) -> if(i < a, w, get(words, cast(a + (i - a) % p as int))))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
