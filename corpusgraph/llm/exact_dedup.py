"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes, Spark's external sort
places equal texts next to each other, and each neighbour is compared in full.
Splitters order by (first characters, 64-bit hash, doc_id): what the driver
samples is bounded, and a text with very many copies is cut at document ids
into ranges of even size. Such a run then lies on the edges of partitions; the
runs at edges (the first and last key of each partition) are merged in a
second step, again by full text.

Cases: null text counts as empty; a null id sorts last, and stays only where
its group has no other; of repeated rows with one id and one text, one stays;
an empty table gives no rows. Columns other than id and text are ignored by
``exact_duplicates`` and carried as they are by ``exact_distinct``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, materialize

PREFIX, BROADCAST_EDGES = 32, 500_000
_RUN = "__run_"


def normalize(text: bytes) -> bytes:
    """Each run of the bytes 20 and 09-0D becomes one space."""
    body = b" ".join(text.split())
    if not body:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + body + (b" " if text[-1:].isspace() else b"")


def _keyed(text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [normalize(t) for t in as_bytes(batch.column(batch.schema.get_field_index(text_column)))]
            columns = [*batch.columns, pa.array([x[:PREFIX] for x in norm], pa.binary()), pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in norm], pa.int64()), pa.array(norm, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, f"{_RUN}prefix", f"{_RUN}hash", f"{_RUN}norm"])

    return run


def _runs(id_column: str, carry: list[str]):
    """Compare neighbours of one sorted partition. Without carry: a row per document; with it: the first row of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, block, key, first = TaskContext.get().partitionId(), 0, [], None, True
        out: list[tuple] = []
        rows: list[pa.RecordBatch] = []

        def flush(edge: bool) -> None:
            nonlocal number
            for norm, ids, row in block:
                number += 1
                token = f"{part}:{number}" if edge else None
                text = norm if edge else None
                if carry:
                    rows.append(row)
                    out.append((ids[0], len(ids), token, text))
                    continue
                sha = hashlib.sha256(norm).hexdigest()
                out.extend((x, ids[0], len(ids), k == 0, sha, token, text if k == 0 else None) for k, x in enumerate(ids))
            block.clear()

        def emit() -> pa.RecordBatch:
            if carry:
                kept = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                names, kinds = ("keep", "size", "token", "norm"), (kept.schema.field(id_column).type, pa.int64(), pa.string(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                batch = pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*carry, *(_RUN + n for n in names)])
                rows.clear()
            else:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.binary())
                batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "keep", "size", "first", "sha", "token", "norm"])
            out.clear()
            return batch

        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            prefixes, hashes, norms, ids = (at[n].to_pylist() for n in (f"{_RUN}prefix", f"{_RUN}hash", f"{_RUN}norm", id_column))
            for i, norm in enumerate(norms):
                if key != (prefixes[i], hashes[i]):
                    if key is not None:
                        flush(first)
                        first = False
                    key = (prefixes[i], hashes[i])
                if block and block[-1][0] == norm:
                    block[-1][1].append(ids[i])
                else:
                    block.append((norm, [ids[i]], batch.slice(i, 1).select(carry) if carry else None))
            if len(out) >= 2000:
                yield emit()
        if block:
            flush(True)
        if out:
            yield emit()

    return run


def _sorted_runs(docs: DataFrame, id_column: str, text_column: str, carry: list[str]) -> DataFrame:
    use = docs if carry else docs.select(F.col(id_column).cast("long").alias(id_column), text_column)
    fields = list(use.schema.fields)
    keyed = use.mapInArrow(_keyed(text_column), T.StructType([*fields, T.StructField(f"{_RUN}prefix", T.BinaryType()), T.StructField(f"{_RUN}hash", T.LongType()), T.StructField(f"{_RUN}norm", T.BinaryType())]))
    if not carry:
        keyed = keyed.drop(text_column)
    order = [F.col(f"{_RUN}prefix"), F.col(f"{_RUN}hash"), F.col(id_column).asc_nulls_last()]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order[:2], F.col(f"{_RUN}norm"), order[2])
    if carry:
        kinds = T.StructType([*fields, T.StructField(f"{_RUN}keep", docs.schema[id_column].dataType), T.StructField(f"{_RUN}size", T.LongType()), T.StructField(f"{_RUN}token", T.StringType()), T.StructField(f"{_RUN}norm", T.BinaryType())])
    else:
        kinds = "doc_id long, keep long, size long, first boolean, sha string, token string, norm binary"
    return materialize(dealt.mapInArrow(_runs(id_column, carry), kinds), "content-sort")


def _merged_edges(runs: DataFrame, p: str = "") -> DataFrame:
    """One row per run on a partition's edge, with what its text's runs come to together: a few rows per partition."""
    edge = runs.where(F.col(f"{p}norm").isNotNull()).select(F.col(f"{p}token").alias("token"), F.col(f"{p}norm").alias("norm"), F.col(f"{p}keep").alias("keep"), F.col(f"{p}size").alias("size"))
    whole = edge.groupBy("norm").agg(F.min(F.struct(F.col("keep").isNull().alias("none"), "keep", "token")).alias("best"), F.sum("size").alias("all_size"))
    return edge.join(whole, "norm").select("token", F.col("best.keep").alias("all_keep"), F.col("best.token").alias("winner"), "all_size")


def _placed(edges: DataFrame) -> DataFrame:
    """At most the runs of two keys per partition: broadcast while they are few, joined by shuffle beyond."""
    edges = materialize(edges, "edges")
    return F.broadcast(edges) if edges.count() <= BROADCAST_EDGES else edges


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = _sorted_runs(docs, id_column, text_column, [])
    edges = _merged_edges(runs)
    joined = runs.drop("norm").join(_placed(edges), "token", "left")
    on_edge = F.col("winner").isNotNull()
    return joined.select(
        F.col("doc_id").alias(id_column),
        F.when(on_edge, F.col("all_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("first") & F.coalesce(F.col("winner") == F.col("token"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_distinct(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; ids are of any type that has an order."""
    runs = _sorted_runs(docs, id_column, text_column, docs.columns)
    edges = _merged_edges(runs, _RUN).select(F.col("token").alias(f"{_RUN}token"), F.col("winner").alias(f"{_RUN}winner"))
    joined = runs.join(_placed(edges), f"{_RUN}token", "left")
    return joined.where(F.coalesce(F.col(f"{_RUN}winner") == F.col(f"{_RUN}token"), F.lit(True))).select(*docs.columns)
