"""Near-duplicate join on word n-gram sets by chosen paths.

Sets are the hashes of all runs of five words (a text of one to four words is one run). Texts with
the same set are one node. A node's paths are drawn by hashing: at the root a token of x is chosen
in a run if its hash lies below branch / |x|, so two sets that overlap choose the same tokens and
meet in that token's bucket. Small buckets are compared by brute force. The nodes of large ones are
dealt again by sampled tokens, those first that are rarest in large buckets, and so many of each node that
a pair at the threshold must have one in common (a prefix filter, which is right in any common order: it
loses nothing but pairs whose samples are unusually unlike). A large bucket whose nodes don't thereby come
to less than half of its comparisons holds sets that are alike throughout and is compared in pairs of
blocks; those of the others are dealt again until no large bucket or no depth is left. The number of
independent runs follows from the target recall: a pair at the threshold shares branch * threshold chosen
tokens a run on average (a Poisson count), misses are multiplied, and the miss of splits, which is the same
at every level, is added.

How rare a token is comes from a table of ORDER_SLOTS counts of hashed tokens, whose size doesn't grow with
the corpus; tokens that share a slot only make the order worse, never the result.

Inside buckets nodes are compared on a consistent sample of their tokens with a margin far below
the threshold; this gives only groups of candidates, as spanning trees, never lists of pairs.
Then every group's whole sets are compared exactly, in blocks of bounded number and size, which counts the
links of each node and yields spanning trees of the exact links, whose components are the classes.
Every stage deals rows by bucket or block, so a group of a third of all rows is spread over many
tasks; nothing but counts reaches the driver.

Result: doc_id, class_id (least doc_id of the class), n_links (other documents whose similarity is
at least the threshold; a copy counts). Cases: null, empty and wordless texts all have the empty set
and are copies of one another; repeated rows are copies; rows with a null doc_id count as copies
where others share their set, and a class of null ids alone has a null class_id; two texts under
one doc_id fall in one class; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import WordHashes, components, kgrams, long_id, materialise, mix, sliced, table, with_facts, word_hashes, word_list

SAMPLE = 64
#: Sketches pass well below the threshold; the exact comparison decides.
SLACK = 0.25
#: Share of the permitted misses that splits of large buckets may take.
SPLIT_MISSES = 0.3
ORDER_SLOTS = 1 << 18
#: Tokens that a block's sets have together on average, at most.
BLOCK_TOKENS = 1_000_000


def shingles(text: str | None, seen: WordHashes, n: int = 5) -> np.ndarray:
    """Distinct hashes of the runs of n words, ascending; one run if there are fewer words."""
    hashes = word_hashes(word_list(text), seen)
    return np.unique(kgrams(hashes, min(n, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def chosen(tokens: np.ndarray, seed: int, rate: float) -> np.ndarray:
    """The tokens whose seeded hash lies below rate / number of tokens."""
    if rate >= len(tokens):
        return tokens
    return tokens[mix(tokens ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) < np.uint64(int(rate / len(tokens) * 2**64))]


def runs_for(recall: float, threshold: float, branch: float) -> int:
    return max(1, math.ceil(math.log((1 - recall) * (1 - SPLIT_MISSES)) / (-branch * threshold)))


def prefixes(threshold: float, miss: float, most: int = 4 * SAMPLE) -> tuple[list[int], list[int]]:
    """By number of sampled tokens: how many of them, in any common order, meet a like set's own; for whole sets, for samples.

    Of c tokens at least threshold * c are in the other set. Of a sample that number is at least as high as
    a binomial one, of which the lowest value is taken that a pair falls below with a chance of miss / 2 a side.
    """
    whole, sampled = [], []
    for c in range(most + 1):
        whole.append(c - math.ceil(threshold * c - 1e-9) + 1)
        shared, below = 0, (1 - threshold) ** c
        while below <= miss / 2 and shared < c:
            shared += 1
            below += math.comb(c, shared) * threshold**shared * (1 - threshold) ** (c - shared)
        sampled.append(c - shared + 1)
    return whole, sampled


def paths(docs: DataFrame, n: int, runs: int, branch: float) -> DataFrame:
    """(doc_id, digest, size, keys, sample) of each text: its root buckets and its sampled tokens."""

    def prepare(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        seen = WordHashes()
        for batch in sliced(batches):
            digests, sizes, keys, samples = [], [], [], []
            for text in batch.column(1):
                tokens = shingles(text.as_py(), seen, n)
                digests.append(xxhash.xxh3_128_hexdigest(tokens.tobytes()))
                sizes.append(len(tokens))
                keys.append(np.concatenate([mix(chosen(tokens, run, branch) + np.uint64(run)) for run in range(1, runs + 1)]).view(np.int64))
                samples.append(chosen(tokens, 0, SAMPLE).view(np.int64))
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32), np.concatenate([np.empty(0, np.int64), *found])) for found in (keys, samples)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(sizes, pa.int32()), *lists], ["doc_id", "digest", "size", "keys", "sample"])

    return docs.mapInArrow(prepare, "doc_id long, digest string, size int, keys array<long>, sample array<long>")


class Forest:
    """Union-find over numbers 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set its number and how many members it shares with every set of the list."""
    n, sizes = len(sets), [len(x) for x in sets]
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(n), sizes)
    order = np.argsort(tokens, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(tokens))])
    listed, at = owners[order], np.concatenate([[0], np.cumsum(sizes)])
    for i in range(n):
        own = tokens[at[i] : at[i + 1]]
        first, count = starts[own], starts[own + 1] - starts[own]
        where = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        yield i, np.bincount(listed[where], minlength=n)


def like_sketches(rows: list[tuple], threshold: float) -> Iterator[tuple[int, int]]:
    """Spanning trees of the pairs whose sampled similarity may reach the threshold.

    rows: (node, block, size, sample); with two blocks only pairs across them matter, but those
    within are as good for a spanning tree.
    """
    sizes = np.array([max(1, r[2]) for r in rows], float)
    samples = [np.asarray(r[3], np.int64) for r in rows]
    counts = np.array([len(x) for x in samples], float)
    # both sets sample at a rate of SAMPLE / size: tokens that the larger set would take are comparable
    rates = np.minimum(1, SAMPLE / sizes)
    forest = Forest(len(rows))
    for i, shared in overlaps(samples):
        least = np.minimum(rates, rates[i])
        union = np.maximum(1, counts * least / rates + counts[i] * least / rates[i] - shared)
        near = (shared >= (threshold - SLACK) * union) & (np.minimum(sizes, sizes[i]) >= threshold * np.maximum(sizes, sizes[i]))
        for j in np.nonzero(near)[0].tolist():
            if j > i and forest.join(i, j):
                yield rows[i][0], rows[j][0]


def exact_links(rows: list[tuple], threshold: float) -> tuple[list[int], list[tuple[int, int]]]:
    """Weighted links of each row and a spanning tree of the links.

    rows: (node, block, copies, set); rows of two blocks are linked only across, of one only within.
    """
    sets, blocks = [r[3] for r in rows], np.array([r[1] for r in rows])
    sizes, copies = np.array([len(x) for x in sets]), np.array([r[2] for r in rows])
    across, forest, edges, links = len(set(blocks.tolist())) > 1, Forest(len(rows)), [], []
    for i, shared in overlaps(sets):
        # s / (a + b - s) >= p / q in whole numbers, so that ties at the threshold are decided exactly
        union = sizes + sizes[i] - shared
        near = shared * 1000 >= round(threshold * 1000) * union
        near &= (blocks != blocks[i]) if across else (np.arange(len(rows)) != i)
        links.append(int(copies[near].sum()))
        edges += [(rows[i][0], rows[j][0]) for j in np.nonzero(near)[0].tolist() if forest.join(i, j)]
    return links, edges


def segments(batches: Iterator, key: int, columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of sorted batches, gathered while their first `key` columns stay the same."""
    now, held = None, []
    for batch in batches:
        lists = [batch.column(c) for c in columns]
        heads = [x.to_pylist() for x in lists[:key]]
        rest = [x.to_pylist() for x in lists[key:]]
        for head, row in zip(zip(*heads, strict=True), zip(*rest, strict=True), strict=True):
            if head != now:
                if held:
                    yield held
                now, held = head, []
            held.append(row)
    if held:
        yield held


def block_pairs(df: DataFrame, blocks: Column, node: str) -> DataFrame:
    """Adds block, p, q: a row is dealt to each pair of blocks that its own block is part of."""
    dealt = df.withColumn("blocks", F.greatest(F.lit(1), F.ceil(blocks)).cast("int")).withColumn("block", F.pmod(F.xxhash64(node, F.lit(5)), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("blocks", "other")


def gathered(rows: DataFrame) -> DataFrame:
    """(key, n, node) of the buckets of more than one node; buckets with the same members are taken once."""
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s")).where("n > 1")
    buckets = buckets.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n")
    return materialise(rows.join(buckets, "key").select("key", "n", "node"), "buckets")


def split(large: DataFrame, sketches: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(key, node): the nodes of large buckets by their rarest sampled tokens, so many that like nodes meet."""
    spark = large.sparkSession
    inside = materialise(sketches.join(large.select("node").distinct(), "node"), "split")
    slot = F.explode(F.transform("sample", lambda t: F.pmod(t, F.lit(ORDER_SLOTS))))
    often = inside.select(slot.alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(ORDER_SLOTS, np.int64)
    counts[often.column("slot").to_numpy()] = often.column("n").to_numpy()
    shared, (whole, sampled) = spark.sparkContext.broadcast(counts), prefixes(threshold, miss)

    def prefix(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = []
            for size, sample in zip(batch.column("size").to_pylist(), batch.column("sample"), strict=True):
                tokens = sample.values.to_numpy().view(np.uint64)
                # up to this size neither set of a pair is larger than a sample
                known = whole if size <= threshold * SAMPLE else sampled
                most = known[len(tokens)] if len(tokens) < len(known) else len(tokens)
                order = np.lexsort((mix(tokens), shared.value[(tokens % np.uint64(ORDER_SLOTS)).astype(np.int64)]))[:most]
                keys.append(mix(tokens[order] + np.uint64(7)).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *keys]))], ["node", "keys"])

    return inside.select("node", "size", "sample").mapInArrow(prefix, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def candidate_edges(nodes: DataFrame, threshold: float, block: int, whole: int, depth: int, miss: float) -> DataFrame:
    """(a, b): spanning trees of candidate groups among nodes (node, size, keys, sample)."""

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in segments(batches, 3, ["key", "p", "q", "node", "block", "size", "sample"]):
            if len(rows) > 1 and (edges := list(like_sketches(rows, threshold))):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], ["a", "b"])

    def compared(members: DataFrame) -> DataFrame:
        dealt = block_pairs(members.join(sketches, "node"), F.col("n") / block, "node").select("key", "p", "q", "node", "block", "size", "sample")
        return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(compare, "a long, b long")

    sketches = nodes.select("node", "size", "sample")
    members = gathered(nodes.select("node", F.explode(F.array_distinct("keys")).alias("key")))
    found = None
    for level in range(depth + 1):
        large = members.where(F.col("n") > whole)
        last = level == depth or not large.head(1)
        if not last:
            parts = gathered(split(large, sketches, threshold, miss))
            # a bucket is alike throughout if its nodes have half of its comparisons or more in the parts, too
            load = large.join(parts.groupBy("node").agg(F.sum("n").alias("load")), "node", "left")
            alike = load.groupBy("key", "n").agg(F.sum("load").alias("load")).where(2 * F.col("load") >= F.col("n") * F.col("n")).select("key", F.lit(True).alias("alike"))
            judged = materialise(members.join(alike, "key", "left").select("key", "n", "node", F.coalesce("alike", F.col("n") <= whole).alias("now")), "judged")
            members, rest = judged.where("now").drop("now"), judged.where("not now").select("node").distinct()
        edges = compared(members)
        found = edges if found is None else found.unionByName(edges)
        if last:
            return found
        members = gathered(parts.select("key", "node").join(rest, "node"))
    return found


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, branch: float = 4.0, block: int = 512, whole: int = 4096, depth: int = 8) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    rows = docs.select(long_id(), F.col("text").cast("string").alias("text"))
    made = materialise(paths(rows, n, runs_for(recall, threshold, branch), branch), "paths")
    copies = made.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).cast("int").alias("copies"), F.max("size").alias("size"))
    copies = materialise(copies, "copies")
    n_rows = made.count()
    firsts = copies.where(F.col("node").isNotNull()).select("digest", "node")
    nodes = made.where("size > 0").join(firsts, (made.doc_id == firsts.node) & (made.digest == firsts.digest)).select("node", "size", "keys", "sample")
    groups = components(candidate_edges(nodes, threshold, block, whole, depth, (1 - recall) * SPLIT_MISSES))
    groups = groups.join(copies, "node").select("node", "component", "digest", "copies", "size")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BLOCK_TOKENS).alias("n"))
    groups = with_facts(groups, sizes, "component", "members", n_rows).select("node", "component", "n", "digest", "copies")

    def whole_sets(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        seen = WordHashes()
        for batch in sliced(batches):
            sets = [shingles(x.as_py(), seen, n).tobytes() for x in batch.column("text")]
            same = [xxhash.xxh3_128_hexdigest(s) == d.as_py() for s, d in zip(sets, batch.column("digest"), strict=True)]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "n", "node", "copies", "digest")), pa.array(sets, pa.binary())], ["component", "n", "node", "copies", "digest", "members"])
            yield out.filter(pa.array(same, pa.bool_()))

    sets = rows.join(groups, rows.doc_id == groups.node).select("component", "n", "node", "copies", "digest", "text")
    sets = sets.mapInArrow(whole_sets, "component long, n double, node long, copies int, digest string, members binary")
    sets = sets.dropDuplicates(["component", "node", "digest"]) if rows_repeat(made) else sets
    dealt = block_pairs(sets, F.col("n"), "node").select("component", "p", "q", "node", "block", "copies", "members")

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for held in segments(batches, 3, ["component", "p", "q", "node", "block", "copies", "members"]):
            held = [(*r[:3], np.frombuffer(r[3], np.uint64)) for r in held]
            if len(held) < 2:
                continue
            links, edges = exact_links(held, threshold)
            out = [(r[0], None, k) for r, k in zip(held, links, strict=True) if k] + [(a, b, 0) for a, b in edges]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64()), strict=True)], ["a", "b", "n"])

    found = materialise(dealt.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q").mapInArrow(verify, "a long, b long, n long"), "links")
    classes = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    known = copies.join(classes, "node", "left").join(links, "node", "left").select("digest", "copies", F.coalesce("component", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return with_facts(made.select("doc_id", "digest"), known, "digest", "copies", n_rows).select("doc_id", "class_id", "n_links")


def rows_repeat(made: DataFrame) -> bool:
    """Whether a doc_id comes more than once, so that a node's text must be told from its repetitions."""
    return bool(made.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
