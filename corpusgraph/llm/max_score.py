"""Exact top-k search by inner product: MaxScore over the vectors' components.

A vector's components, scaled and rounded down to whole numbers, are its terms:
each dimension has a list of the rows with a positive value there and one of
those with a negative value, each with its largest magnitude. For a query, the
list of a dimension's own sign can add at most weight x magnitude and the other
list only takes away. Lists are ordered by this bound. Those at the end whose
bounds together stay below the k-th best score so far are non-essential: a row
that is only in them cannot enter the result. The essential lists are traversed
and add up in accumulators; the other terms are probed for the rows that can
still reach the k-th best score, best bounds first. While fewer than k rows are
known, or the k-th score is not above zero, every row is a candidate.

Candidates are dealt to shards of at most ``shard_rows`` rows and queries to
blocks of at most ``block_queries``; a task cogroups one shard with one block,
so that its memory is bounded whatever the number of either, and gives k rows
a query. A second step merges the shards. Nothing is broadcast.

Cases: vectors that are null or hold a null or non-finite component take no
part. Missing components of shorter vectors count as zero. A query's own row is
told by its id, so repeated rows of a query's id are no candidates of it, and
the least of them asks; other repeated rows each take a rank. Rows with a null
id can be found, and come last among equal scores, but do not ask. Components
are limited to the 64-bit range, scores too; where sums could pass it they are
computed in unbounded integers. Fewer candidates than k give fewer rows; no
vectors or no queries give none. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_QUERIES, ROWS = 65_536, 16_384, 1024
#: Shards are smaller than that where there would be too few to keep a cluster's tasks even.
SPREAD, LEAST_ROWS = 64, 128
_LONG = 2**63


def whole(vector: Column, scale: int = 256) -> Column:
    """Components as whole numbers; null where one is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros. Python's integers where 64 bits might not hold a sum."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    width = int(sizes.max(initial=0))
    flat = np.asarray(column.flatten())
    if (sizes == width).all():
        out = flat.reshape(len(sizes), width)
    else:
        out = np.zeros((len(sizes), width), np.int64)
        out[np.arange(width) < sizes[:, None]] = flat
    return out


def _small(*all_values: np.ndarray) -> bool:
    most, width = 1, max(1, all_values[0].shape[1])
    for values in all_values:
        if values.size:
            most *= max(abs(int(values.min())), abs(int(values.max())), 1)
    return most * width < _LONG


class Postings:
    """The posting lists of a block of rows: for each dimension and sign the rows, their magnitudes and the largest of these."""

    def __init__(self, rows: np.ndarray):
        self.rows, width = rows, rows.shape[1]
        self.lists: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        self.most = np.zeros((2, width), rows.dtype)
        for d in range(width):
            column = rows[:, d]
            for side, at in enumerate((np.flatnonzero(column > 0), np.flatnonzero(column < 0))):
                sizes = abs(column[at])
                self.lists[side].append((at, sizes))
                if len(at):
                    self.most[side, d] = sizes.max()

    def search(self, query: np.ndarray, least) -> tuple[np.ndarray, np.ndarray]:
        """Rows, with their scores, among which are all that score least or more (all rows if that is None)."""
        weight, side = abs(query), (query < 0).astype(int)
        bound = weight * self.most[side, np.arange(len(query))]
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        if least is None or least <= 0:
            return np.arange(len(self.rows)), self.rows @ query
        essential = int(np.argmax(rest < least))  # the first place from which all bounds together stay below
        found = np.zeros(len(self.rows), self.rows.dtype)
        for d in order[:essential]:
            rows, sizes = self.lists[side[d]][d]
            found[rows] += weight[d] * sizes
        at = np.flatnonzero((found > 0) & (found + rest[essential] >= least))
        first = order[:essential]
        score = found[at] + np.minimum(self.rows[np.ix_(at, first)] * query[first], 0).sum(axis=1)
        for j in range(essential, len(order)):
            keep = score + rest[j] >= least
            at, score = at[keep], score[keep]
            if not len(at):
                break
            score = score + self.rows[at, order[j]] * query[order[j]]
        return at, score


def _order(score, other) -> tuple:
    return -score, other is None, other if other is not None else 0


def _searched(k: int):
    """One shard of candidates (left) for one block of queries (right): each query's k best."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors = left.column("id").to_pylist(), matrix(left.column("vector"))
        asking, queries = right.column("id").to_pylist(), matrix(right.column("vector"))
        out: list[tuple] = []
        width = min(vectors.shape[1], queries.shape[1])
        vectors, queries = vectors[:, :width], queries[:, :width]
        if not _small(vectors, queries):
            vectors, queries = vectors.astype(object), queries.astype(object)
        best: list[list[tuple]] = [[] for _ in asking]
        own: dict = {}
        for r, other in enumerate(ids):
            own.setdefault(other, []).append(r)
        for start in range(0, len(ids), ROWS):
            block = Postings(vectors[start : start + ROWS])
            for q, query in enumerate(queries):
                top = best[q]
                rows, scores = block.search(query, -top[-1][0] if len(top) == k else None)
                if asking[q] in own:
                    other = ~np.isin(rows + start, own[asking[q]])
                    rows, scores = rows[other], scores[other]
                if len(scores) > k:  # of a block only those not below its own k-th score
                    keep = scores >= (np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k])
                    rows, scores = rows[keep], scores[keep]
                new = (_order(s, ids[start + r]) for r, s in zip(rows.tolist(), scores.tolist(), strict=True))
                best[q] = heapq.nsmallest(k, [*top, *new])
        for q, top in enumerate(best):
            out += [(asking[q], None if none else other, max(-_LONG, min(_LONG - 1, -score))) for score, none, other in top]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """For each row of queries, its k best rows of vectors other than itself: query_id, rank, vec_id, score."""
    rows, asking = (
        df.select(F.col(id_column).cast("long").alias("id"), whole(F.col(vector_column), scale).alias("vector")).where("vector is not null") for df in (vectors, queries)
    )
    asking = asking.where("id is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    n, n_queries = rows.count(), asking.count()
    shards = max(-(-n // shard_rows), min(SPREAD, -(-n // LEAST_ROWS)), 1)
    blocks = max(-(-n_queries // block_queries), 1)
    # numbers by place: rows that repeat spread over the shards
    left = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards).cast("long"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asking.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
