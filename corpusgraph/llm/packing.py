"""Bounded-space online best-fit packing of token sequences.

Each partition keeps a fixed number of open bins, grouped by free space; an
integer used as a bitset has bit f set while a bin with f free tokens is open.
A piece goes to the fullest bin that still holds it (the lowest set bit at or
above its length). If none does, a new bin opens, and where that exceeds the
bound the fullest bin closes first. A document longer than a sequence is cut
so that every piece but its first is a whole sequence, so only first pieces
need fitting. Partitions pack on their own: no shuffle, constant memory, and a
lost task repeats with the same result.

What a partition leaves open or closes early is packed again with that of
other partitions: such bins are the items of a second round, counted and dealt
into shares of about ``SHARE``, their documents moving with them by a join on
the bin. A share is put into an order of its own first and its result is written,
so that the order in which shuffled rows arrive changes nothing.

Cases: null text is empty and gives the end token alone; repeated rows are
separate documents; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 1024
OPEN_BINS = 512
SHARE = 100_000
END = 2
_CACHE = 300_000
SPECIAL = "<|endoftext|>"


def tokenizer(vocabulary: str, ranks: str | None = None):
    """A function from text to the ids of the vocabulary as little-endian unsigned 32-bit bytes.

    The vocabulary is byte-level BPE whose pretokens never run across a single
    space between other characters, so a text splits there and each chunk's ids
    are kept. With ranks (the same vocabulary as rank file), chunks are encoded
    by tiktoken, which gives the same ids faster.
    """
    import array

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    pack = lambda ids: array.array("I", ids).tobytes()
    slow = lambda text: pack(whole.encode(text, add_special_tokens=False).ids)
    if ranks:
        import base64

        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        encode = lambda text: pack(fast(text))
    else:
        encode = slow

    class Chunks(dict):
        def __missing__(self, chunk: str) -> bytes:
            if len(self) >= _CACHE:
                self.clear()
            ids = encode(chunk)
            if len(chunk) < 40:
                self[chunk] = ids
            return ids

    chunks = Chunks()

    def run(text: str) -> bytes:
        if SPECIAL in text:
            return slow(text)
        parts = text.split(" ")
        if "" in parts or len(parts) > 1 and any(p[0].isspace() or p[-1].isspace() for p in parts):
            return encode(text)
        head = chunks[parts[0]]
        return head + b"".join([chunks[" " + p] for p in parts[1:]])

    return run


class Bins:
    """The open bins of one packer."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = 0

    def _put(self, bin_id: int, free: int) -> None:
        if free:
            self.free[free].append(bin_id)
            self.bits |= 1 << free
            self.open += 1

    def _pop(self, free: int) -> int:
        bins = self.free[free]
        bin_id = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_id

    def place(self, length: int, new: int) -> tuple[int, int]:
        """The bin and the place in it; a bin that has to be opened gets the number new. A bin's free space is its list's index."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            bin_id = self._pop(free)
        else:
            if self.open >= self.limit:  # the fullest closes
                self._pop((self.bits & -self.bits).bit_length() - 1)
            bin_id, free = new, self.capacity
        self._put(bin_id, free - length)
        return bin_id, self.capacity - free


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack(id_column: str, text_column: str, vocabulary: str, ranks: str | None, capacity: int, limit: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, bins, number = tokenizer(vocabulary, ranks), Bins(capacity, limit), TaskContext.get().partitionId() << 36
        stop, crc = end.to_bytes(4, "little"), zlib.crc32
        names = [x.split()[0] for x in _PIECES.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(batch.schema.get_field_index(id_column)).to_pylist(), batch.column(batch.schema.get_field_index(text_column)).to_pylist(), strict=True):
                ids = encode(text or "") + stop
                n = len(ids) // 4
                first = n % capacity or capacity
                bin_id, at = bins.place(first, number)
                number += 1
                out.append((doc, 0, 0, first, crc(ids[: 4 * first]), bin_id, at))
                for k, start in enumerate(range(first, n, capacity), 1):  # whole sequences
                    out.append((doc, k, start, capacity, crc(ids[4 * start : 4 * (start + capacity)]), number, 0))
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names) if out else pa.RecordBatch.from_pylist([], pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in names]))

    return run


def _again(capacity: int, limit: int):
    """Bins (sequence_id, used) -> the bin that each moves to, and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, limit)
        for batch in batches:
            order = pc.sort_indices(batch, sort_keys=[("used", "descending"), ("sequence_id", "ascending")])
            batch = batch.take(order)
            to, at = [], []
            for seq, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bin_id, place = bins.place(used, seq)
                to.append(bin_id)
                at.append(place)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int64()), pa.array(at, pa.int64())], names=["sequence_id", "to_id", "shift"])

    return run


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end: int = END, share: int = SHARE) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    placed = docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(_pack(id_column, text_column, vocabulary, ranks, capacity, open_bins, end), _PIECES)
    first = materialize(placed, "packed")
    # what is not full takes part in the second round
    used = first.where(F.col("length") < capacity).groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < capacity)
    used = materialize(used, "unfilled")
    shares = max(1, -(-used.count() // share))
    # shuffled blocks arrive in any order: an order of their own, and a written result, give a repeated task the same places
    dealt = used.repartition(shares, "sequence_id").sortWithinPartitions(F.xxhash64("sequence_id"), "sequence_id")
    moved = materialize(dealt.mapInArrow(_again(capacity, open_bins), "sequence_id long, to_id long, shift long"), "moved")
    whole = first.where(F.col("length") == capacity)
    rest = first.where(F.col("length") < capacity).join(moved, "sequence_id", "left")
    rest = rest.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to_id", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return whole.unionByName(rest)
