"""Near copies by exact Jaccard similarity of five-word shingles, for the pipeline.

Candidates come from two indexes. One is that of ``simhash``: the SimHash of a
document's five-word shingles is listed under the three-byte subsets of its halves,
the shared positional bytes of pairs that meet are tallied, and those within three
bits are candidates. As pairs at a similarity of 0.8 mostly differ in more bits,
the other is a position index over a longer fingerprint: at each of ``HASHES`` positions it holds 16 bits of the smallest
value that a hash function takes on the document's shingles, so two documents
agree at a position with a probability of their Jaccard similarity. The index
lists a document under each ``ROWS`` neighbouring positions; pairs that meet
and agree at ``SHARED`` positions are candidates. At a similarity of 0.8 exactly,
theory puts the share of pairs that never meet at 1e-5 and of those that agree
too rarely at 2e-4; more similar pairs are missed less. A candidate is a link only if the Jaccard
similarity of its documents' sets of shingle hashes is ``LIKENESS`` or more.

Pairs are tried in two rounds, so that a large group of near copies does not
make all its pairs: first each document against the smallest of each entry,
then all pairs of an entry that the first round's links leave in different
components. A pair left out is within a component already. The second round
tries its pairs inside tasks, dealt out by pairs of blocks of ``BLOCK`` rows,
and returns spanning forests only.

Cases: null text is empty; a text of fewer words than a shingle is one shingle;
documents of equal sets, the empty one too, are one node; null ids stay; rows
of one id go together; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize
from .simhash import BITS, BYTES, SUBSETS, _forest, components, majority, shingle_hashes

WORDS, LIKENESS = 5, 0.8
HASHES, ROWS, SHARED, BLOCK = 48, 3, 28, 1024
WIDTH = HASHES + BYTES // 2  # of a print: the smallest values, then the SimHash
_RNG = np.random.default_rng(5)
_FACTOR = _RNG.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, WORDS))


def min_values(h: np.ndarray) -> np.ndarray:
    """Sixteen bits of the smallest value at each position, then the SimHash; no shingles give zeros."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(low, (h[i : i + 2048] * _FACTOR + _SHIFT).min(axis=1), out=low)
    return np.concatenate([low.astype("<u2"), np.array([majority(h)], "<u8").view("<u2")]) if len(h) else np.zeros(WIDTH, dtype="<u2")


def _bytes_of(prints: np.ndarray) -> np.ndarray:
    """The SimHash's bytes of rows of prints."""
    return np.ascontiguousarray(prints[:, HASHES:]).view(np.uint8)


def _candidates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of prints are within three bits, by the tally of positional bytes first, or agree at enough positions."""
    x_hash, y_hash = _bytes_of(x), _bytes_of(y)
    near = (x_hash == y_hash).sum(axis=1) >= BYTES - BITS
    near[near] = np.bitwise_count(x_hash[near] ^ y_hash[near]).sum(axis=1) <= BITS
    return near | ((x[:, :HASHES] == y[:, :HASHES]).sum(axis=1) >= SHARED)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t) for t in as_bytes(b.column(1))]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array([min_values(s).tobytes() for s in sets], pa.binary())], names=["id", "digest", "print"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, print) -> the entries a node is listed under: the positions' number above their values."""
    for b in batches:
        prints = np.frombuffer(b"".join(as_bytes(b.column(1))), dtype="<u2").reshape(-1, WIDTH)
        v = prints[:, :HASHES].astype(np.int64).reshape(-1, HASHES // ROWS, ROWS)
        key = np.arange(HASHES // ROWS)
        for r in range(ROWS):
            key = (key << 16) + v[:, :, r]
        h = _bytes_of(prints).astype(np.int64)
        places = [(HASHES // ROWS + k << 16 * ROWS) + (h[:, i] << 16) + (h[:, j] << 8) + h[:, m] for k, (i, j, m) in enumerate(SUBSETS)]
        key = np.concatenate([key, np.stack(places, axis=1)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), key.shape[1])), pa.array(key.reshape(-1))], names=["node", "entry"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t).tobytes() for t in as_bytes(b.column(1))], pa.binary())], names=["id", "set"])


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two sets of hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _alike(x: bytes, y: bytes) -> bool:
    return likeness(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= LIKENESS


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (as_bytes(b.column(k)) for k in (2, 3))
        keep = pa.array([_alike(s, t) for s, t in zip(x, y)], pa.bool_())
        yield b.select(["a", "b"]).filter(keep)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, x, y) -> a, b whose prints make them candidates."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(as_bytes(b.column(k))), dtype="<u2").reshape(-1, WIDTH) for k in (2, 3))
        yield b.select(["a", "b"]).filter(pa.array(_candidates(x, y)))


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entry, p, q, node, component, print, set) sorted by entry, p, q -> links between the components of each run.

    A pair that meets in several entries is tried in the first of them; a run returns a spanning forest of its links.
    """

    def links(key: np.ndarray, node: np.ndarray, part: np.ndarray, prints: np.ndarray, sets: list[bytes]) -> pa.RecordBatch:
        found_a, found_b = [], []
        lag, live = 1, np.arange(len(key))
        while True:
            live = live[live + lag < len(key)]
            live = live[(key[live] == key[live + lag]).all(axis=1)]
            if not len(live):
                break
            other = live[part[live] != part[live + lag]]
            for i in range(0, len(other), 1 << 16):
                x = other[i : i + (1 << 16)]
                one, two = prints[x], prints[x + lag]
                alike = _bytes_of(one) == _bytes_of(two)
                met = np.concatenate([(one == two)[:, :HASHES].reshape(-1, HASHES // ROWS, ROWS).all(axis=2), alike[:, np.array(SUBSETS)].all(axis=2)], axis=1)
                x = x[(met.argmax(axis=1) == key[x, 0] >> 16 * ROWS) & _candidates(one, two)]
                x = x[[_alike(sets[k], sets[k + lag]) for k in x.tolist()]] if len(x) else x
                found_a.append(node[x])
                found_b.append(node[x + lag])
            lag += 1
        a, b = _forest(np.concatenate(found_a), np.concatenate(found_b)) if found_a else (node[:0], node[:0])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rest = None
    for batch in batches:
        numbers = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
        prints = np.frombuffer(b"".join(as_bytes(batch.column(5))), dtype="<u2").reshape(-1, WIDTH)
        sets = as_bytes(batch.column(6))
        if rest is not None:
            numbers, prints, sets = np.concatenate([rest[0], numbers]), np.concatenate([rest[1], prints]), rest[2] + sets
        if not len(numbers):
            continue
        whole = np.flatnonzero((numbers[:, :3] != numbers[-1, :3]).any(axis=1))
        end = int(whole[-1]) + 1 if len(whole) else 0  # the last run may go on in the next batch
        if end:
            yield links(numbers[:end, :3], numbers[:end, 3], numbers[:end, 4], prints[:end], sets[:end])
        rest = numbers[end:], prints[end:], sets[end:]
    if rest is not None:
        yield links(rest[0][:, :3], rest[0][:, 3], rest[0][:, 4], rest[1], rest[2])


def _both(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """pairs (a, b) with the value of each side; rows has id and value."""
    left = rows.select(F.col("id").alias("a"), F.col(value).alias("x"))
    right = rows.select(F.col("id").alias("b"), F.col(value).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _sets_of(ids: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """id, set for the documents whose id is in ids."""
    return materialize(docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(_sets, "id long, set binary"), name)


def links(docs: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs (id, text), nodes (node, print) -> links a < b with the components of all similar pairs."""
    prints = nodes.select(F.col("node").alias("id"), "print")
    entries = materialize(nodes.select("node", "print").mapInArrow(_entries, "node long, entry long").distinct(), "near-entries")
    sizes = entries.groupBy("entry").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    shared = materialize(entries.join(sizes, "entry"), "near-shared")
    tried = materialize(shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "near-first")
    near = materialize(_both(tried, prints, "print").mapInArrow(_agreeing, "a long, b long").distinct(), "near-agreeing")
    sets = _sets_of(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, "near-sets")
    found = materialize(_both(near, sets, "set").mapInArrow(_verify, "a long, b long").distinct(), "near-links")

    parts = shared.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = materialize(parts.select("entry", "n", "node", "component"), "near-parts")
    mixed = parts.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("entry")
    parts = materialize(parts.join(mixed, "entry", "left_semi"), "near-mixed")
    sets = _sets_of(parts.select(F.col("node").alias("id")).distinct(), docs, "near-mixed-sets")
    dealt = parts.withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.join(prints.withColumnRenamed("id", "node"), "node").join(sets.withColumnRenamed("id", "node"), "node")
    dealt = dealt.select("entry", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "component", "print", "set")
    apart = dealt.repartition("entry", "p", "q").sortWithinPartitions("entry", "p", "q").mapInArrow(_apart, "a long, b long")
    return found.unionByName(materialize(apart.distinct(), "near-apart"))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: id, component_id (the smallest id reachable)."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    prints = materialize(rows.mapInArrow(_prints, "id long, digest binary, print binary"), "near-prints")
    nodes = materialize(prints.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node"), F.any_value("print").alias("print")), "near-nodes")
    joined = components(links(rows, nodes))
    labels = nodes.join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return prints.join(labels, "digest", "left").select("id", F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows whose id is not its component's smallest; rows of one id go together, null ids stay."""
    gone = near_copies(docs, id_column, text_column).where("id <> component_id").select(F.col("id").alias(id_column))
    return docs.join(gone, id_column, "left_anti").select(*docs.columns)
