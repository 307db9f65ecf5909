"""Benchmark decontamination by winnowing.

Every text is a sequence of words. Of the hashes of its k-grams, winnowing keeps the least one of
each run of w consecutive ones (the rightmost of equals), so two texts that share k + w - 1 words
in a row keep a common fingerprint at the same place of the shared span. Fingerprints of documents
are joined with those of the benchmark, hits are extended word by word along their diagonal, and an
extended span of at least `window` words (with k + w - 1 = window) marks its words. Items of fewer
words than a window are one window of their own length; for each such length w is 1 and k is the
length, so that every k-gram is kept.

A benchmark of at most `index_words` words is broadcast, indexed once in each worker, and documents are read in
one pass without a shuffle. Beyond that bound, fingerprints are joined: documents emit those that pass a bitmap
of fixed size, these meet the benchmark's by equi-join (each posting once for each of SALTS parts of the
documents, so that a passage that a third of all share isn't one task's), and only documents and items that
share a fingerprint are brought together to be extended. Both ways use the same fingerprints and the same
extension, so they agree.

Cases: null and empty texts have no words; an item without words has no window; items are counted
by their id, so repeated rows of an item count once; an item with a null id marks words but is not
listed; repeated documents each give a row; other columns are left out, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import WordHashes, kgrams, long_id, materialise, sliced, table, word_hashes, word_list

FILTER_BITS = 22
SALTS = 16
#: The index that this worker made last, by name.
_KNOWN: dict[str, Index] = {}


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Ascending places of the kept k-grams; all windows' rightmost least one."""
    n = len(grams)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(grams[::-1]))])
    best, place = grams[: n - w + 1].copy(), np.arange(n - w + 1)
    for i in range(1, w):
        here = grams[i : n - w + 1 + i]
        less = here <= best
        best[less] = here[less]
        place[less] += i - (place[less] - np.nonzero(less)[0])
    return np.unique(place)


def prints(hashes: np.ndarray, window: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(length, gram, place) of an item's fingerprints; length is 0 for winnowed ones, else the words of a short item."""
    n = len(hashes)
    grams = kgrams(hashes, k if n >= window else n)
    for place in winnow(grams, window - k + 1) if n >= window else range(len(grams)):
        yield 0 if n >= window else n, int(grams[place]), int(place)


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def filled(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[slots(grams)] = True
    return bits


def candidates(grams: np.ndarray, length: int, bits: np.ndarray | None, long: bool, w: int) -> np.ndarray:
    """Which of a document's k-grams may be fingerprints of an item: those that pass the bitmap and, of a long document, the winnowing."""
    likely = np.ones(len(grams), bool) if bits is None else bits[slots(grams)]
    if length == 0 and long and likely.any():
        kept = np.zeros(len(grams), bool)
        kept[winnow(grams, w)] = True
        likely = likely & kept
    return likely


class Index:
    """Fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], window: int, k: int, filtered: bool = True) -> None:
        self.window, self.k, self.w = window, k, window - k + 1
        seen = WordHashes()
        distinct = {}
        for item_id, text in items:
            if words := word_list(text):
                distinct.setdefault(tuple(words), set()).add(item_id)
        self.items = [(word_hashes(list(words), seen), ids) for words, ids in distinct.items()]
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, (hashes, _) in enumerate(self.items):
            for length, gram, place in prints(hashes, window, k):
                self.postings[length][gram].append((number, place))
        self.postings = {length: dict(found) for length, found in self.postings.items()}
        self.filters = {length: filled(np.fromiter(found, np.uint64, len(found))) if filtered else None for length, found in self.postings.items()}

    def spans(self, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """(start, end) of shared spans in words, and the ids of the items that have them."""
        found, ids = [], set()
        for length, postings in self.postings.items():
            grams = kgrams(hashes, length or self.k)
            if not len(grams):
                continue
            likely = candidates(grams, length, self.filters[length], len(hashes) >= self.window, self.w)
            if not likely.any():
                continue
            reached: dict[tuple[int, int], int] = {}
            for p in np.nonzero(likely)[0].tolist():
                for number, q in postings.get(int(grams[p]), ()):
                    item, owners = self.items[number]
                    if p < reached.get((number, p - q), -1):
                        continue
                    start, end = self._extend(hashes, item, p, q)
                    reached[number, p - q] = end
                    if end - start >= min(self.window, len(item)):
                        found.append((start, end))
                        ids |= owners
        return found, ids

    @staticmethod
    def _extend(text: np.ndarray, item: np.ndarray, p: int, q: int) -> tuple[int, int]:
        back = min(p, q)
        differs = np.nonzero(text[p - back : p][::-1] != item[q - back : q][::-1])[0]
        start = p - (int(differs[0]) if len(differs) else back)
        ahead = min(len(text) - p, len(item) - q)
        differs = np.nonzero(text[p : p + ahead] != item[q : q + ahead])[0]
        return start, p + (int(differs[0]) if len(differs) else ahead)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def known_index(name: str, shared: object, window: int, k: int) -> Index:
    """The index of a broadcast benchmark, made once in each worker."""
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = Index(shared.value, window, k)
    return _KNOWN[name]


def arrow_hits(found: list[tuple[int, list[tuple[int, int]], set]]) -> list:
    """Columns n_words, starts, ends and items of (words, merged spans, ids)."""
    import pyarrow as pa

    lists = [[[s for s, _ in spans] for _, spans, _ in found], [[e for _, e in spans] for _, spans, _ in found]]
    ids = [sorted(str(x) for x in owners if x is not None) for *_, owners in found]
    return [pa.array([n for n, *_ in found], pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in lists), pa.array(ids, pa.list_(pa.string()))]


HITS = ["n_words", "starts", "ends", "items"]
HITS_SCHEMA = "n_words long, starts array<int>, ends array<int>, items array<string>"


def with_hits(rows: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, index_words: int = 2_000_000) -> DataFrame:
    """row and n_words, starts, ends (merged hit spans in words) and items (ids of the items found); rows has one
    struct column `row` with a text among its fields."""
    if not 1 <= k <= window:
        raise ValueError("k must be between 1 and window")
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 2 * index_words:  # a word and its separator take two characters at least
        return joined_hits(rows, items, window, k)
    name, shared = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast([tuple(x) for x in items.collect()])

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, seen = known_index(name, shared, window, k), WordHashes()
        for batch in sliced(batches):
            found = []
            for text in batch.column("row").field("text"):
                words = word_list(text.as_py())
                spans, owners = known.spans(word_hashes(words, seen))
                found.append((len(words), merged(spans), owners))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrow_hits(found)], ["row", *HITS])

    return rows.mapInArrow(search, f"row {rows.schema['row'].dataType.simpleString()}, {HITS_SCHEMA}")


def joined_hits(rows: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """with_hits() for a benchmark of any size: fingerprints are joined, then the texts of what they bring together."""
    spark, w = rows.sparkSession, window - k + 1
    items = items.groupBy("text").agg(F.collect_set("item_id").alias("ids")).withColumn("item", F.xxhash64("text"))

    def posted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = WordHashes()
        for batch in batches:
            out = [(item, length, gram) for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True) for length, gram, _ in prints(word_hashes(word_list(text), seen), window, k)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array(np.array([x[2] for x in out], np.uint64).view(np.int64))], ["item", "length", "gram"])

    postings = materialise(items.where("text is not null").select("item", "text").mapInArrow(posted, "item long, length int, gram long").distinct(), "postings")
    slot = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    bits: dict[int, np.ndarray] = {}
    parts = postings.select("length", F.floor(slot / 32768).alias("part"), (slot % 32768).alias("bit")).groupBy("length", "part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    for length, part, packed in parts:
        own = bits.setdefault(length, np.zeros(1 << FILTER_BITS, bool))
        own[part * 32768 : (part + 1) * 32768] = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[:32768]
    shared = spark.sparkContext.broadcast({length: np.packbits(own) for length, own in bits.items()})

    def emitted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, filters = WordHashes(), {length: np.unpackbits(own).astype(bool) for length, own in shared.value.items()}
        for batch in sliced(batches):
            n_words, own = [], []
            for text in batch.column("row").field("text"):
                hashes = word_hashes(word_list(text.as_py()), seen)
                n_words.append(len(hashes))
                grams = {length: kgrams(hashes, length or k) for length in filters}
                own.append([{"length": length, "gram": g} for length, x in grams.items() if len(x) for g in np.unique(x[candidates(x, length, filters[length], len(hashes) >= window, w)]).view(np.int64).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_words, pa.int64()), pa.array(own, pa.list_(pa.struct([("length", pa.int32()), ("gram", pa.int64())])))], ["row", "n_words", "prints"])

    keyed = rows.mapInArrow(emitted, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, prints array<struct<length:int,gram:long>>")
    keyed = materialise(keyed.withColumn("key", F.xxhash64("row")), "prints")
    salt = F.pmod("key", F.lit(SALTS)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    emits = keyed.select("key", salt, F.explode("prints").alias("x")).select("key", "salt", "x.*").distinct()
    pairs = emits.join(postings.select("*", every), ["length", "gram", "salt"]).select("key", "salt", "item").distinct()
    pairs = pairs.join(items.select("item", "ids", F.col("text").alias("item_text"), every), ["item", "salt"]).select("key", "ids", "item_text")
    texts = keyed.where(F.size("prints") > 0).select("key", F.col("row.text").alias("text")).dropDuplicates(["key"])

    def extended(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = WordHashes()
        for batch in batches:
            keys, out = [], []
            for key, text, ids, item in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "ids", "item_text")), strict=True):
                spans, _ = Index([(0, item)], window, k, filtered=False).spans(word_hashes(word_list(text), seen))
                if spans:
                    keys.append(key)
                    out.append((0, merged(spans), ids))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *arrow_hits(out)], ["key", *HITS])

    found = texts.join(pairs, "key").select("key", "text", F.transform("ids", lambda x: x.cast("string")).alias("ids"), "item_text").mapInArrow(extended, "key long, " + HITS_SCHEMA)
    found = found.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("s"), F.flatten(F.collect_list("ends")).alias("e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    fold = """aggregate(array_sort(arrays_zip(s, e)), cast(array() as array<struct<s:int,e:int>>),
        (out, x) -> if(size(out) > 0 and x.s <= element_at(out, -1).e,
            concat(slice(out, 1, size(out) - 1), array(named_struct('s', element_at(out, -1).s, 'e', greatest(x.e, element_at(out, -1).e)))),
            concat(out, array(named_struct('s', x.s, 'e', x.e)))))"""
    found = found.select("key", F.expr(fold).alias("spans"), "items")
    none = F.array().cast("array<int>")
    out = keyed.select("row", "n_words", "key").join(found, "key", "left")
    return out.select("row", "n_words", F.coalesce("spans.s", none).alias("starts"), F.coalesce("spans.e", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, index_words: int = 2_000_000) -> DataFrame:
    """A row per document: words, hit words, items found and whether any word is hit."""
    rows = docs.select(F.struct(long_id(), F.col("text").cast("string").alias("text")).alias("row"))
    found = with_hits(rows, benchmark, window, k, index_words)
    n_hit = F.expr("aggregate(zip_with(starts, ends, (s, e) -> cast(e - s as long)), 0L, (a, x) -> a + x)")
    return found.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, index_words: int = 2_000_000) -> DataFrame:
    """The documents in which no benchmark window occurs, each row by its own text; all their columns travel with it."""
    found = with_hits(docs.select(F.struct(*docs.columns).alias("row")), benchmark, window, k, index_words)
    return found.where(F.size("starts") == 0).select("row.*")


def op9_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = """
with d as (
  select doc_id, row_number() over () as r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
b as (
  select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as g
  from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
dw as (
  select r, i, m, array_to_string(w[i : i + m - 1], ' ') as g
  from (select d.r, d.w, s.m, unnest(range(1, len(d.w) - s.m + 2)) as i from d, (select distinct m from bw) s where len(d.w) >= s.m)),
hit as (select dw.r, dw.i, dw.m, bw.item_id from dw join bw on dw.g = bw.g and dw.m = bw.m),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from (select distinct r, i, m from hit)) group by r),
found as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by r)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join found using (r)
"""
