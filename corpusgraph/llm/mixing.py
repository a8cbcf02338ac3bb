"""Mixing sources to target weights by subset-sum budget fitting.

Targets are shares by weight, limited to a multiple of the source's size; the
excess goes to the others by weight (water filling, in closed form). A source's
target is met by whole repeats of all its documents and, for the budget that
remains, a subset: documents are counted by exact length, every length gets
its share rounded down, what is then left is fitted over the lengths, largest
first, down to less than two of the longest lengths, and a bounded-knapsack
dynamic program over the rest finds the sum nearest to the budget. The chosen
number of documents of each length are those with the smallest seeded hash.

Cases: null text has size 0; a null source is a source of its own and comes
last; documents of size 0 are taken only as whole repeats; repeated rows are
separate documents, with ties broken by row; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StringType, StructField, StructType

from .common import as_bytes, materialize

WEIGHTS = (5, 2, 1)
LIMIT = 3
SLICES = 256
SEED = 7
_OWN = "__mix_"  # names of columns beside those of the caller
SRC, SIZE, DRAW, SLICE = (f"{_OWN}{x}" for x in ("src", "size", "draw", "slice"))


def _sized(text_column: str, source_column: str, keep: list[str]):
    def run(batches):
        for b in batches:
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            size = [len(t.split()) for t in as_bytes(at[text_column])]
            key = ["" if s is None else f"={s}" for s in at[source_column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[at[k] for k in keep], pa.array(key, pa.string()), pa.array(size, pa.int64())], names=[*keep, SRC, SIZE])

    return run


def targets(per_source: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """src, total -> with weight and target. src is the source after "=", or empty for null. One row per source goes through one window."""
    order = Window.orderBy(F.col("src") == "", "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int") + 1)
    t = per_source.withColumn("weight", w).withColumn("cap", F.lit(float(limit)) * F.col("total"))
    # fill in the order in which sources reach their limit; those before a source are full, the rest share by weight
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("total").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("level", left / F.sum("weight").over(after)).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level["level"])).select("src", "total", "weight", "target")


def _bounded_sums(budget: int, counts: list[tuple[int, int]]) -> dict[int, int]:
    """The multiset of lengths, at most counts of each, whose sum is nearest to budget; bit i of a reach is the sum i."""
    if budget <= 0 or not counts:
        return {}
    top = budget + max(length for length, _ in counts)
    mask, reach, steps = (1 << (top + 1)) - 1, 1, []
    for length, have in counts:
        have, part = min(have, top // length), 1
        while have > 0:  # binary split of the count
            steps.append((length, min(part, have)))
            have, part = have - part, part * 2
    # of all reaches, one in every width is kept; those between are made again on the way back
    width, marks = math.isqrt(len(steps)) + 1, []
    for i, (length, take) in enumerate(steps):
        if i % width == 0:
            marks.append(reach)
        reach = (reach | (reach << (length * take))) & mask
        if (reach >> budget) & 1:
            steps = steps[: i + 1]
            break
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> budget
    more = budget + (above & -above).bit_length() - 1 if above else None
    at = more if more is not None and more - budget < budget - below else below
    taken: dict[int, int] = {}
    for block in reversed(range(len(marks))):
        part = steps[block * width : (block + 1) * width]
        had = [marks[block]]
        for length, take in part[:-1]:
            had.append((had[-1] | (had[-1] << (length * take))) & mask)
        for (length, take), before in zip(reversed(part), reversed(had), strict=True):
            if not (before >> at) & 1:
                taken[length] = taken.get(length, 0) + take
                at -= length * take
    return taken


def fit(lengths: pd.DataFrame) -> pd.DataFrame:
    """One source's counted lengths (size, n, total, target) -> (src, size, quota)."""
    total, target = float(lengths["total"].iloc[0]), float(lengths["target"].iloc[0])
    whole = int(target // total) if total > 0 else 1
    budget = max(0, round(target - whole * total))
    size, have = lengths["size"].to_numpy(dtype="int64"), lengths["n"].to_numpy(dtype="int64")
    quota = (have * (budget / total)).astype("int64") if total > 0 else have * 0
    quota[size == 0] = 0
    left = int(budget - (quota * size).sum())
    order = sorted(range(len(size)), key=lambda i: -size[i])
    longest = int(size.max()) if len(size) else 0
    for i in order:  # down to a rest that the dynamic program covers
        if left <= 2 * longest:
            break
        if size[i]:
            more = min(int(have[i] - quota[i]), (left - 2 * longest) // int(size[i]))
            quota[i] += more
            left -= more * int(size[i])
    rest = sorted(((int(size[i]), int(have[i] - quota[i])) for i in range(len(size)) if size[i] and have[i] > quota[i]), reverse=True)
    chosen = _bounded_sums(left, rest)
    quota = quota + [chosen.get(int(s), 0) for s in size]
    return pd.DataFrame({"src": lengths["src"], "size": size, "quota": quota, "whole": whole})


def _has_map(kind: DataType) -> bool:
    """Whether a type holds a map anywhere: such values have no hash."""
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def _planned(docs: DataFrame, keep: list[str], id_column: str, text_column: str, source_column: str, weights: Sequence[float], limit: float, seed: int) -> DataFrame:
    """The columns to keep with own columns source, size, total, target and copies."""
    fields = [docs.schema[k] for k in keep]
    schema = StructType([*fields, StructField(SRC, StringType()), StructField(SIZE, LongType())])
    sized = docs.select(*dict.fromkeys([*keep, id_column, text_column, source_column])).mapInArrow(_sized(text_column, source_column, keep), schema)
    drawn = sized.withColumn(DRAW, F.xxhash64(F.lit(seed), F.col(id_column))).withColumn(SLICE, F.pmod(F.shiftright(DRAW, 40), F.lit(SLICES)))
    counted = materialize(drawn.groupBy(SRC, SIZE, SLICE).agg(F.count("*").alias("n")), "lengths").withColumnsRenamed({SRC: "src", SIZE: "size", SLICE: "slice"})
    lengths = counted.groupBy("src", "size").agg(F.sum("n").alias("n"))
    goal = targets(lengths.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("total")), weights, limit)
    quotas = lengths.join(goal, "src").select("src", "size", "n", "total", "target").groupBy("src").applyInPandas(fit, "src string, size long, quota long, whole long")
    # how many of a length lie in the slices before each slice: of a large group, only one slice is ranked against its quota
    ahead = Window.partitionBy("src", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    plan = placed.join(quotas, ["src", "size"]).join(goal, "src").select("src", "size", "slice", "ahead", "quota", "whole", "total", "target")
    plan = plan.withColumnsRenamed({"src": SRC, "size": SIZE, "slice": SLICE} | {k: f"{_OWN}{k}" for k in ("ahead", "quota", "whole", "total", "target")})
    ties = [F.xxhash64(*[c for c in keep if not _has_map(docs.schema[c].dataType)])] if len(keep) > 1 else []
    rank = F.row_number().over(Window.partitionBy(SRC, SIZE, SLICE).orderBy(DRAW, id_column, *ties))
    rows = drawn.withColumn(f"{_OWN}rank", rank).join(plan, [SRC, SIZE, SLICE])
    taken = F.col(f"{_OWN}ahead") + F.col(f"{_OWN}rank") <= F.col(f"{_OWN}quota")
    return rows.withColumn(f"{_OWN}copies", F.col(f"{_OWN}whole") + taken.cast("long")).withColumn(f"{_OWN}source", F.when(F.col(SRC) != "", F.expr(f"substring({SRC}, 2)")))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: Sequence[float] = WEIGHTS, limit: float = LIMIT, seed: int = SEED) -> DataFrame:
    """A row per document: id, src, size, source_size, target, copies, taken."""
    rows = _planned(docs, [id_column], id_column, text_column, source_column, weights, limit, seed)
    copies, size = F.col(f"{_OWN}copies"), F.col(SIZE)
    return rows.select(F.col(id_column).alias("id"), F.col(f"{_OWN}source").alias("src"), size.alias("size"), F.col(f"{_OWN}total").alias("source_size"), F.col(f"{_OWN}target").alias("target"), copies.alias("copies"), (copies * size).alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: Sequence[float] = WEIGHTS, limit: float = LIMIT, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as many times as the mix takes it."""
    rows = _planned(docs, docs.columns, id_column, text_column, source_column, weights, limit, seed)
    return rows.withColumn(f"{_OWN}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{_OWN}copies")))).where(F.col(f"{_OWN}copies") > 0).select(*docs.columns)
