"""Best-fit packing of tokenised documents into sequences of a fixed length.

Method: bounded-space online best-fit. Pieces arrive one by one; a fixed number of bins is open,
found through a bitset with one bit per amount of free space; a piece goes to the open bin with
the least free space that still holds it; when too many bins are open the fullest closes.

Each document is encoded, cut and summed up where it is read. Pieces are numbered there, and written;
groups are hashes of these numbers, a fixed number of documents each on average, so that their number
follows the corpus, no group grows with it, and neither null nor repeated ids gather in one. Only
(doc_id, piece, start, length, checksum) is dealt out to the packing groups, and the ids where asked for.

Cases: a null or empty text is one piece holding only the closing id; a null doc_id stays null; one that
isn't a whole number is null too; repeated rows are packed as often as they come; other columns are left
out, whatever their names; an empty table packs into no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import long_id, materialise, sliced, table

#: How the public byte-level vocabularies cut a text before merging, and the settings of files that do so.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
RESULT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the vocabulary in a tokenizer file.

    A text is cut at each single space between two characters that aren't white space, where no
    token of a byte-level vocabulary can cross; the ids of such a chunk are remembered. Texts
    with other runs of white space beside a space are encoded whole. Texts that hold a token which the
    file adds to its vocabulary go through the file's own tokenizer, and so do all texts if the file changes texts
    first, or cuts them or merges in another way than the byte-level vocabularies that this is made for.
    """

    LIMIT = 300_000

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        import tokenizers

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]["vocab"]
        self.added = [t["content"] for t in stored.get("added_tokens") or []]
        self.whole = tokenizers.Tokenizer.from_file(path)
        pre = stored.get("pre_tokenizer") or {}
        known = all(pre.get(k) == v for k, v in BYTE_LEVEL.items()) and all((stored["model"].get(k) or None) == (v or None) for k, v in PLAIN_MODEL.items())
        self.plain = known and not stored.get("normalizer") and not stored.get("truncation")
        self.seen: dict[str, bytes] = {}
        if not self.plain:
            return
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model.items() if all(c in byte_of for c in token) and not token.startswith("<|")}
        self.encode_one = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _bytes(self, text: str) -> bytes:
        from array import array

        return array("I", self.encode_one(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.plain or any(t in text for t in self.added):
            from array import array

            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        parts = text.split(" ")
        if len(parts) < 3 or any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            return self._bytes(text)
        seen, out = self.seen, [self._bytes(parts[0])]
        for part in parts[1:]:
            ids = seen.get(part)
            if ids is None:
                if len(seen) >= self.LIMIT:
                    seen.clear()
                ids = self._bytes(" " + part)
                if len(part) < 64:
                    seen[part] = ids
            out.append(ids)
        return b"".join(out)


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: whole pieces of room, a shorter one first."""
    if n <= room:
        return [(0, n)]
    first = n % room
    return [(0, first)] * bool(first) + [(i, room) for i in range(first, n, room)]


def pieces(docs: DataFrame, room: int, tokenizer: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) of each document's pieces, and their ids if asked for."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, closing = Encoder(tokenizer), end_id.to_bytes(4, "little")
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            rows: list[tuple] = []
            cuts: list[bytes] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encoder(text.as_py() or "") + closing)
                for k, (s, n) in enumerate(cut(len(ids) // 4, room)):
                    own = ids[4 * s : 4 * (s + n)]
                    rows.append((row, doc_id, k, s, n, zlib.crc32(own)))
                    row += 1
                    if with_ids:
                        cuts.append(bytes(own))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = pa.array([0, *accumulate(len(c) // 4 for c in cuts)], pa.int32())
                arrays.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(cuts))])))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    rows = docs.select(long_id(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, PIECES + ", ids array<int>" * with_ids)


class BestFit:
    """Open bins by free space. put() returns (bin, offset) of a piece."""

    def __init__(self, room: int, open_bins: int) -> None:
        self.room, self.most, self.open, self.made, self.closed = room, open_bins, 0, 0, 0
        self.bits = 0  # bit f is set while a bin with f free places is open
        self.bins: list[list[int]] = [[] for _ in range(room + 1)]

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + ((fitting & -fitting).bit_length() - 1)
            here = self._take(free)
        else:
            free, here = self.room, self.made
            self.made += 1
        if left := free - length:
            self.bins[left].append(here)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self.closed += 1
                self._take((self.bits & -self.bits).bit_length() - 1)
        return here, self.room - free

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        here = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return here


def pack(made: DataFrame, n_documents: int, room: int = 1024, open_bins: int = 128, group_documents: int = 10_000) -> DataFrame:
    """Adds sequence_id and offset to pieces, in place of their row numbers.

    Pieces that fill a sequence need no bin. The others (one a document at most) are dealt out to groups of
    about group_documents documents by a hash of their number. Within a group they arrive in the order of another hash,
    whatever their lengths, and are placed one by one. The order is the same in every run.
    """
    groups = max(1, -(-n_documents // group_documents))
    ids = ["ids"] if "ids" in made.columns else []
    columns = [*RESULT, *ids]
    full = made.where(F.col("length") == room).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    dealt = made.where(F.col("length") < room).withColumn("group", F.pmod(F.xxhash64("row", F.lit(11)), F.lit(groups))).withColumn("arrival", F.xxhash64("row", F.lit(12)))
    part = dealt.repartition(groups, "group").sortWithinPartitions("group", "arrival", "row")

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, packer, base = None, None, 0
        for batch in sliced(batches, 1000):
            sequence, offset = [], []
            for group, length in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if group != now:
                    now, packer, base = group, BestFit(room, open_bins), group << 36
                here, at = packer.put(length)
                sequence.append(base + here)
                offset.append(at)
            made_up = {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
            yield pa.RecordBatch.from_arrays([made_up[c] if c in made_up else batch.column(c) for c in columns], columns)

    packed = part.mapInArrow(place, PIECES.removeprefix("row long, ") + ", sequence_id long, offset long" + ", ids array<int>" * len(ids))
    return packed.unionByName(full.select(*columns))


def best_fit(docs: DataFrame, room: int = 1024, tokenizer: str | None = None, end_id: int = 2, open_bins: int = 128, group_documents: int = 10_000, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the place that each has, and with their ids if asked for."""
    made = materialise(pieces(docs, room, tokenizer or default_tokenizer(), end_id, with_ids), "pieces")
    n_documents = made.where(F.col("piece") == 0).count()
    return pack(made, n_documents, room, open_bins, group_documents)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
