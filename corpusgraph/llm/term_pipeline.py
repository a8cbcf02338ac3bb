"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners, by hash. Documents are read once into shards of bounded
size; a shard gives one posting row for each term that any item asks for. Items
travel in bundles: for each bundle and shard, sparse accumulators (item,
documents, scores) go through one owner after the other. A stage is a cogroup
of the accumulators with that owner's postings, adds the owner's integer
contributions and hands the accumulators on. The last stage also meets the
shard's document ids and keeps each item's k best; the shards' results are then
merged. A stage's group holds one bundle (at most ``BUNDLE`` items) and one shard
(at most ``SHARD_DOCS`` documents, or one document past ``SHARD_TERMS`` terms),
whatever the corpus: a term that all documents hold only has more posting rows.

Score of a document for an item: the sum, over the item's terms once each, of
w * ((1000000000 * tf) div (1000 * tf + 20 * m)), where
w = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 50 + ((50 * n * N) div L).
N counts documents with a term, L all their terms, n those of one document.

Cases: null texts and texts without a term count for nothing and are never
found; items without a term find nothing; a repeated row is another document
with the same id; a null id comes last among equal scores; repeated rows of an
item id are one item with all their terms, a null item id is an item like any
other. No documents or no items give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize, release

SHARD_DOCS, SHARD_TERMS, BUNDLE, OWNERS = 2048, 2_000_000, 256, 3
#: So many terms of items at most go to every task; with more, all terms of documents are written and joined.
LISTED_TERMS = 200_000

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POSTINGS = "shard long, term binary, docs array<int>, tfs array<int>, ns array<long>"
_BUNDLES = "bundle int, shard long, item long, docs array<int>, scores array<long>"


def terms(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters; only A-Z are lower-cased."""
    return text.translate(_WORD).split()


def _posted(listed: frozenset | None):
    """Documents -> shards' posting rows, and a row per shard whose term is null: its documents' ids under ns, their numbers of terms under tfs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, size, held = TaskContext.get().partitionId() << 32, 0, []
        postings: dict[bytes, tuple[list, list]] = {}

        def flush() -> pa.RecordBatch:
            sizes = np.array([n for _, n in held], np.int64)
            keys, docs, tfs = list(postings), [d for d, _ in postings.values()], [t for _, t in postings.values()]
            columns = [
                pa.array([shard] * (len(keys) + 1), pa.int64()),
                pa.array([*keys, None], pa.binary()),
                pa.array([*docs, None], pa.list_(pa.int32())),
                pa.array([*tfs, sizes], pa.list_(pa.int32())),
                pa.array([*(sizes[d] for d in docs), [x for x, _ in held]], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "docs", "tfs", "ns"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                counts = Counter(terms(text))
                n = counts.total()
                if not n:
                    continue
                for term in counts if listed is None else listed.intersection(counts):
                    row = postings.setdefault(term, ([], []))
                    row[0].append(len(held))
                    row[1].append(counts[term])
                held.append((doc, n))
                size += n
                if len(held) >= SHARD_DOCS or size >= SHARD_TERMS:
                    yield flush()
                    shard, size = shard + 1, 0
                    held.clear(), postings.clear()
        if held:
            yield flush()
        release()

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, term) for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True) for term in set(terms(text))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.binary())], names=["item_id", "term"])


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    array = column.combine_chunks()
    values, ends = np.asarray(array.flatten().fill_null(0)), np.asarray(array.value_lengths().fill_null(0)).cumsum()
    return np.split(values, ends[:-1]) if len(ends) else []


def _stage(documents: int, all_terms: int, last: int | None):
    """One owner's stage for one bundle and shard. With last: the k best of each item, by document id."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        bundle, shard = (k.as_py() for k in key)
        carried, posted = _lists(left.column("docs")), _lists(right.column("docs"))
        top = 1 + max((int(d[-1]) for d in (*carried, *posted) if len(d)), default=-1)
        found: dict[int | None, np.ndarray] = {}
        for item, at, scores in zip(left.column("item").to_pylist(), carried, _lists(left.column("scores")), strict=True):
            found[item] = np.zeros(top, np.int64)
            found[item][at] = scores
        ids: list = []
        columns = (right.column("items").to_pylist(), right.column("w").to_pylist(), posted, _lists(right.column("tfs")), _lists(right.column("ns")))
        for row, (items, w, at, tf, n) in enumerate(zip(*columns, strict=True)):
            if items is None:
                ids = right.column("ns")[row].as_py()
                continue
            m, tf = 50 + 50 * n * documents // all_terms, tf.astype(np.int64)
            gain = w * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            for item in items:
                if item not in found:
                    found[item] = np.zeros(top, np.int64)
                found[item][at] += gain
        out = []
        for item, scores in found.items():
            at = np.flatnonzero(scores)
            if last is not None and len(at) > last:
                at = at[scores[at] >= np.partition(scores[at], len(at) - last)[len(at) - last]]  # ties of the last place stay
            out.append((item, at, scores[at]))
        if last is None:
            rows = {"bundle": pa.array([bundle] * len(out), pa.int32()), "shard": pa.array([shard] * len(out), pa.int64()), "item": pa.array([r[0] for r in out], pa.int64())}
            return pa.table(rows | {"docs": pa.array([r[1] for r in out], pa.list_(pa.int32())), "scores": pa.array([r[2] for r in out], pa.list_(pa.int64()))})
        flat = [(item, ids[d], s) for item, at, scores in out for d, s in zip(at.tolist(), scores.tolist(), strict=True)]
        return pa.table({n: pa.array([r[i] for r in flat], pa.int64()) for i, n in enumerate(("item", "doc", "score"))})

    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", owners: int = OWNERS
) -> DataFrame:
    """The k best documents of each item, by falling score and rising id: item_id, rank, doc_id, score."""
    spark, result = docs.sparkSession, "item_id long, rank int, doc_id long, score long"
    asked = items.select(F.col(item_column).cast("long").alias("item"), F.col(item_text).alias("text")).mapInArrow(_item_terms, "item long, term binary").distinct()
    asked = materialize(asked, "item-terms")
    n_items = asked.select("item").distinct().count()
    if not n_items:
        return spark.createDataFrame([], result)
    bundles = -(-n_items // BUNDLE)
    by_term = asked.groupBy("term", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle")).agg(F.transform(F.collect_list(F.struct("item")), lambda x: x["item"]).alias("items"))
    size = asked.select("term").distinct().agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    listed = None
    if size["n"] <= LISTED_TERMS and size["bytes"] <= 100 * LISTED_TERMS:
        listed = frozenset(r["term"] for r in asked.select("term").distinct().collect())
    postings = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(_posted(listed), _POSTINGS)
    if listed is None:
        postings = materialize(postings, "all-postings")  # shards are numbered by the tasks that make them
        postings = postings.where("term is null").unionByName(postings.where("term is not null").join(asked.select("term"), "term", "left_semi").select(*postings.columns))
    postings = materialize(postings, "postings")
    sums = postings.where("term is null").agg(F.sum(F.size("ns")).alias("n"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
    if not sums["n"]:
        return spark.createDataFrame([], result)
    df = postings.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(sums["n"]) + 2) / (2 * F.col("df") + 1))).cast("long")
    owned = by_term.join(df, "term").select("term", "bundle", "items", weight.alias("w"), F.pmod(F.xxhash64("term"), F.lit(owners)).alias("owner"))
    owned = materialize(owned, "owned-terms")
    place = F.broadcast if listed is not None and asked.count() <= 50 * LISTED_TERMS else lambda x: x
    carried = spark.createDataFrame([], _BUNDLES)
    for owner in range(owners):
        last = owner == owners - 1
        met = postings.join(place(owned.where(F.col("owner") == owner)), "term").select("bundle", "shard", "items", "w", "docs", "tfs", "ns")
        if last:
            ids = postings.where("term is null").select(F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), "shard", "ns")
            met = met.unionByName(ids, allowMissingColumns=True)
        stage = carried.groupBy("bundle", "shard").cogroup(met.groupBy("bundle", "shard"))
        carried = stage.applyInArrow(_stage(sums["n"], sums["terms"], k if last else None), "item long, doc long, score long" if last else _BUNDLES)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = carried.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
