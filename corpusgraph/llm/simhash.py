"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint is eight bytes at fixed positions. Two fingerprints that differ
in at most three bits share at least five of them, and so at least three in one
half (positions 0-3 or 4-7). The index therefore lists each distinct
fingerprint under the three-byte subsets of its halves: eight entries. Pairs
that meet in an entry have their shared positional bytes tallied, those with
five or more are kept, and their differing bits are counted.

An entry longer than ``BLOCK`` is dealt out by pairs of blocks, so that none of
its pairs is lost and no task holds it whole; a task returns, of the links it
finds, a spanning forest, which has the same components. Components then follow
from alternating large-star and small-star steps over the forest's edges
(Kiveris et al. 2014), each written to the shared folder.

Cases: null text is empty; a text of no words has fingerprint 0; ids that are
null join no component and are their own; equal fingerprints are one node;
no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize

BYTES, BITS, BLOCK = 8, 3, 4096
SEED = 42
SUBSETS = [(h + a, h + b, h + c) for h in (0, BYTES // 2) for a, b, c in combinations(range(BYTES // 2), 3)]  # the positions of the index entries


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the runs of words of a UTF-8 text; a shorter text is one run, and no words give none."""
    w = text.lower().split()
    if not w:
        return np.empty(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")


def fingerprint(text: bytes, words: int = 3) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    h = shingle_hashes(text, words)
    return int(majority(h))


def majority(h: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes have; no hashes give 0."""
    return np.packbits(_bit_counts(h) * 2 > len(h), bitorder="little").view("<u8")[0] if len(h) else np.uint64(0)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):  # 16-bit lanes: bit k of each lane, 65535 at most
        part = h[i : i + (1 << 14)]
        for k in range(16):
            total[k::16] += ((part >> np.uint64(k)) & np.uint64(0x0001000100010001)).sum(dtype=np.uint64, keepdims=True).view("<u2")
    return total


def _fingerprints(id_column: str, text_column: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, words) for t in as_bytes(b.column(b.schema.get_field_index(text_column)))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(id_column)), pa.array(prints)], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """id, fp: the fingerprint as a signed long."""
    return docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(_fingerprints(id_column, text_column, words), "id long, fp long")


def _entries(fp: Column) -> Column:
    """The index entries of a fingerprint: the positions' number above the three bytes."""
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]
    return F.array(*[F.lit(k << 24) + F.shiftleft(byte[a], 16) + F.shiftleft(byte[b], 8) + byte[c] for k, (a, b, c) in enumerate(SUBSETS)])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links a-b do: each node of a component to the component's smallest."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[label[rest]], nodes[rest]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entry, p, q, fp, node) sorted by entry, p, q -> links between nodes within each run."""

    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        found_a, found_b, held = [], [], 0
        lag, live = 1, np.arange(len(key))
        while True:
            live = live[live + lag < len(key)]
            live = live[(key[live] == key[live + lag]).all(axis=1)]
            if not len(live):
                break
            x = fp[live] ^ fp[live + lag]
            shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)  # the tally of positional bytes
            live_hit = live[shared >= BYTES - BITS]
            hit = live_hit[np.bitwise_count(fp[live_hit] ^ fp[live_hit + lag]) <= BITS]
            found_a.append(node[hit])
            found_b.append(node[hit + lag])
            held += len(hit)
            if held > 500_000:
                a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [a], [b], 0
            lag += 1
        a, b = _forest(np.concatenate(found_a), np.concatenate(found_b)) if found_a else (node[:0], node[:0])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rest = None
    for batch in batches:
        table = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
        table = table if rest is None else np.concatenate([rest, table])
        if not len(table):
            continue
        whole = np.flatnonzero((table[:, :3] != table[-1, :3]).any(axis=1))
        end = int(whole[-1]) + 1 if len(whole) else 0  # the last run may go on in the next batch
        if end:
            yield links(table[:end, :3], np.ascontiguousarray(table[:end, 3]).view(np.uint64), table[:end, 4])
        rest = table[end:]
    if rest is not None and len(rest):
        yield links(rest[:, :3], np.ascontiguousarray(rest[:, 3]).view(np.uint64), rest[:, 4])


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp, node) -> links a < b with the components of all pairs at three bits or fewer."""
    entries = materialize(nodes.select("fp", "node", F.explode(_entries(F.col("fp"))).alias("entry")), "index-entries")
    sizes = entries.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1").select("entry", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    dealt = entries.join(sizes, "entry").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", others).select("entry", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "node")
    found = dealt.repartition("entry", "p", "q").sortWithinPartitions("entry", "p", "q").mapInArrow(_pairs, "a long, b long")
    return materialize(found.distinct(), "links")


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) -> a spanning forest of each batch's links."""
    for b in batches:
        x, y = _forest(b.column(0).to_numpy(), b.column(1).to_numpy()) if b.num_rows else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["v", "u"])


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) -> node, component: the smallest node reachable, for every node with a link.

    Each round takes three shuffles: by node for the large stars, by node for the small ones, and by link for the distinct ones.
    """
    thin = edges.where("a <> b").select("a", "b").mapInArrow(_thinned, "v long, u long")
    e = materialize(thin.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "forest")
    own = Window.partitionBy("u")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.min("v").over(own), F.col("u"))
        large = both.withColumn("low", low).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        star = large.withColumn("low", F.min("v").over(own))
        ends = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v"))))
        e = materialize(star.select(ends.alias("e")).select("e.*").where("u <> v").distinct(), "stars")
        # done when every link leads from a node with no other link to the middle of its star
        roles = e.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        roles = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if roles.where("child > 1 OR (child > 0 AND parent > 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """A row per document: id, fp, component_id (the smallest id reachable)."""
    prints = materialize(fingerprints(docs, id_column, text_column, words), "fingerprints")
    nodes = prints.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("node"))
    nodes = materialize(nodes, "nodes")
    joined = components(links(nodes))
    labels = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(labels, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """docs without the rows whose id is not its component's smallest; rows of one id go together, null ids stay."""
    gone = near_duplicates(docs, id_column, text_column, words).where("id <> component_id").select(F.col("id").alias(id_column))
    return docs.join(gone, id_column, "left_anti").select(*docs.columns)
