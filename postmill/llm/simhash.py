"""Near duplicates by SimHash, with bit-sliced comparison of fingerprints.

A fingerprint has bit i set if more than half of a text's shingle hashes have it. Two link if they differ in at most
`radius` bits. Documents of one fingerprint are one node, so a group of copies is a row however large it is.

Where fingerprints meet: bits are cut into radius + 1 stretches, of which a linked pair has one in common. Nodes
are dealt to buckets by (stretch, its bits). In a bucket larger than `whole` the remaining bits are cut again in the
same way, of which a pair again has a stretch in common, and so on: 16 bits, 28, 37, 44 of 64 are equal in a
bucket, so its size falls with the corpus as it has to. This loses no pair. What is still large at the last level
holds fingerprints that are alike in nearly all bits; it is compared in pairs of blocks.

Inside a bucket bits stand vertically: word b of a lane holds bit b of 64 fingerprints. A query's distance to all 64
is kept in counters of two bits (for radius 3), themselves a word for each bit; planes are added in twos by a carry-save adder, and
a word collects the lanes that have passed the radius. After every eight planes a query drops the lanes in which all
64 have passed, which for unlike fingerprints is soon. A bucket gives a spanning tree of its links, never a
list of pairs; the components of all trees are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import components, long_id, materialise, sliced, table, with_facts

BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose hashes are held at a time, and queries times lanes that are compared at a time.
CHUNK = 65_536
CELLS = 131_072


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64 bits of a text: ASCII letters lower-cased, words between ASCII white space, all its runs of `shingle` words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(at, min(n, at + CHUNK))), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (long, the 64 bits) of every document."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            bits = np.array([fingerprint(text.as_py(), shingle, seed) for text in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(long_id(), F.col("text").cast("string").alias("text")).mapInArrow(read, "doc_id long, fingerprint long")


def cut_masks(taken: int, parts: int) -> list[int]:
    """Masks of `taken` bits and one of `parts` stretches of the remaining ones each."""
    free = [b for b in range(BITS) if not taken >> b & 1]
    ends = [len(free) * k // parts for k in range(parts + 1)]
    return [taken | sum(1 << b for b in free[ends[k] : ends[k + 1]]) for k in range(parts)]


def planes_of(members: np.ndarray) -> np.ndarray:
    """(64, lanes): bit b of 64 fingerprints in each word of row b. members: a multiple of 64 fingerprints."""
    bits = np.unpackbits(members.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, queries: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells (query, lane): the places of cells that hold a hit, and their words of hits."""
    width = (radius + 1).bit_length() if radius & (radius + 1) else radius.bit_length()
    head = (1 << width) - 1 - radius  # counters start here, so that passing the radius is an overflow
    cells = np.arange(len(queries))
    counters = [np.full(len(cells), ALL if head >> k & 1 else 0, np.uint64) for k in range(width)]
    over = np.zeros(len(cells), np.uint64)
    for first in range(0, BITS, 8):
        for b in range(first, first + 8, 2):
            own = [np.where(queries >> np.uint64(k) & np.uint64(1), ALL, np.uint64(0)) for k in (b, b + 1)]
            x, y = (planes[k][lanes] ^ o for k, o in zip((b, b + 1), own, strict=True))
            if width:  # carry-save: the two planes and the lowest counter bit become a sum and one carry
                half = x ^ y
                carry = (x & y) | (half & counters[0])
                counters[0] = counters[0] ^ half
                for k in range(1, width):
                    carry, counters[k] = carry & counters[k], counters[k] ^ carry
            else:
                carry = x | y
            over |= carry
        live = over != ALL
        if not live.all():
            cells, queries, lanes, over = cells[live], queries[live], lanes[live], over[live]
            counters = [c[live] for c in counters]
        if not len(cells):
            break
    return cells, ~over


def spanning(left: np.ndarray, right: np.ndarray, up: np.ndarray) -> tuple[list[int], list[int]]:
    """Those of the links (left, right) that join what wasn't joined in `up` (parents, kept flat), in rounds of one link a component."""

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = int(up[up[i]])
        return i

    a, b = [], []
    while len(left):
        while not np.array_equal(up, up[up]):
            up[:] = up[up]
        fresh = up[left] != up[right]
        left, right = left[fresh], right[fresh]
        for k in np.unique(up[left], return_index=True)[1].tolist():
            i, j = root(int(left[k])), root(int(right[k]))
            if i != j:
                up[max(i, j)] = min(i, j)
                a.append(int(left[k]))
                b.append(int(right[k]))
    return a, b


def trees(members: np.ndarray, begins: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a spanning tree of the links inside each bucket; buckets are stretches of members that begin at `begins`."""
    sizes = np.diff(np.append(begins, len(members)))
    lanes_of = -(-sizes // 64)
    first_lane = np.cumsum(lanes_of) - lanes_of
    owner = np.repeat(np.arange(len(begins)), sizes)
    slot = first_lane[owner] * 64 + np.arange(len(members)) - begins[owner]
    laid, used, place = np.zeros(int(lanes_of.sum()) * 64, np.uint64), np.zeros(int(lanes_of.sum()) * 64, np.uint8), np.zeros(int(lanes_of.sum()) * 64, np.int64)
    laid[slot], used[slot], place[slot] = members, 1, np.arange(len(members))
    planes, used = planes_of(laid), np.packbits(used, bitorder="little").view("<u8")
    # a query is compared with its own lane and those after it, so that each pair is met from its first member
    own = slot // 64
    counts = first_lane[owner] + lanes_of[owner] - own
    cut = np.concatenate([[0], np.cumsum(counts)])
    up, a, b, at = np.arange(len(members)), [], [], 0
    while at < len(members):
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + CELLS, "right")) - 1)
        rows = np.repeat(np.arange(at, to), counts[at:to])
        lanes = own[rows] + np.arange(len(rows)) - (cut[rows] - cut[at])
        cells, hits = within(planes, members[rows], lanes, radius)
        hits = hits & used[lanes[cells]]
        some = hits != 0
        cells, hits = cells[some], hits[some]
        cell, bit = np.nonzero(np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        left, right = rows[cells[cell]], place[lanes[cells[cell]] * 64 + bit]
        more = spanning(left[left < right], right[left < right], up)
        a += more[0]
        b += more[1]
        at = to
    return np.array(a, np.int64), np.array(b, np.int64)


def buckets(batches: Iterator, key: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints of sorted rows and where each bucket begins, some buckets at a time; no bucket is parted."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*key, "fingerprint"]]
        if held is not None:
            now = [np.concatenate(pair) for pair in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        new = np.any([np.diff(c) != 0 for c in now[:-1]], axis=0)
        begins = np.concatenate([[0], np.flatnonzero(new) + 1])
        last = int(begins[-1])
        if last:
            yield now[-1][:last].view(np.uint64), begins[:-1]
        held = [c[last:] for c in now]
    if held is not None and len(held[0]):
        yield held[-1].view(np.uint64), np.array([0])


def compared(rows: DataFrame, key: list[str], radius: int) -> DataFrame:
    """(a, b): spanning trees of the links inside the buckets of rows (key..., fingerprint)."""

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for members, begins in buckets(batches, key):
            i, j = trees(members, begins, radius)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(members[i].view(np.int64)), pa.array(members[j].view(np.int64))], ["a", "b"])

    return rows.select(*key, "fingerprint").repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a long, b long")


def dealt(rows: DataFrame, masks: dict[int, list[int]], bits: Column) -> DataFrame:
    """Each row once for each of its path's masks: path (which mask), key (the bits under it) and fingerprint."""
    signed = [[m - (1 << BITS) if m >> 63 else m for m in group] for group in masks.values()]
    width = len(signed[0])
    lists = F.array(*(F.array(*(F.lit(m).cast("long") for m in group)) for group in signed))
    own = rows.withColumn("own", F.get(lists, bits)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    path = bits * width + F.col("k")
    return own.select(path.cast("int").alias("path"), F.xxhash64(path, F.col("fingerprint").bitwiseAND(F.get("own", F.col("k")))).alias("key"), "fingerprint")


def link_trees(nodes: DataFrame, radius: int = 3, whole: int = 1024, levels: int = 4) -> DataFrame:
    """(a, b) among different fingerprints: edges whose components are those of all links within the radius."""
    n_nodes, parts = nodes.count(), radius + 1
    masks = {0: cut_masks(0, parts)}
    rows, path = nodes.select("fingerprint"), F.lit(0)
    found = None
    for level in range(levels):
        members = dealt(rows, masks, path)
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = materialise(with_facts(members, sizes.withColumn("size", F.col("n")), "key", "n", parts ** (level + 1) * n_nodes), f"simhash-{level}")
        edges = compared(members.where(F.col("size") <= whole), ["key"], radius)
        found = edges if found is None else found.unionByName(edges)
        rows = members.where(F.col("size") > whole)
        if not rows.head(1):
            return found
        masks = dict(enumerate(cut_masks(m, parts) for group in masks.values() for m in group))
        path = F.col("path")
    blocks = F.ceil(2 * F.col("size") / whole).cast("int")
    own = F.pmod(F.xxhash64("fingerprint", F.lit(5)), blocks).cast("int")
    pairs = rows.select("key", "fingerprint", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    pairs = pairs.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "fingerprint")
    return found.unionByName(compared(pairs, ["key", "p", "q"], radius))


def simhash_classes(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, whole: int = 1024, levels: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (least doc_id reached) of every document.

    A null or blank text has fingerprint zero and links like any other; a text of fewer words than a shingle is one
    shingle. A bit that exactly half of the hashes have is 0. Texts are read whole, in pieces of bounded size. doc_id
    is a whole number; a row without one links and is returned, and doesn't name a component unless all of
    it have none (then null). Repeated rows are returned as often as they come. An empty table gives an empty
    result. Other columns aren't read.
    """
    if not 0 <= radius < BITS:
        raise ValueError("the radius is a number of bits below 64")
    made = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    n_rows = made.count()
    nodes = materialise(made.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    linked = components(link_trees(nodes, radius, whole, levels))
    classes = nodes.join(linked, nodes.fingerprint == linked.node, "left").select("fingerprint", "least", "copies", F.coalesce("component", "fingerprint").alias("component"))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = with_facts(classes, names, "component", "members", n_rows).select("fingerprint", "copies", "component_id")
    return with_facts(made, named, "fingerprint", "copies", n_rows).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))
