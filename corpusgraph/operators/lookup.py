"""Lookups over built layers: filters, neighbours, traces, leaks, routes' documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

VISIBLE = 320


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, weight -> src, dst, weight in both directions, without loops."""
    e = edges.where("a <> b").select("a", "b", *(["weight"] if "weight" in edges.columns else [F.lit(1.0).alias("weight")]))
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (src) -> src, dst, weight."""
    return both_ways(edges).join(nodes.select("src").distinct(), "src", "left_semi")


def leaves_of(edges: DataFrame, node: str) -> DataFrame:
    """The neighbours of a node that have no other neighbour: what hiding its branch hides."""
    w = both_ways(edges)
    return w.where(F.col("src") == node).select("dst").join(w.where(F.col("src") != node).where(F.col("dst") != node).select(F.col("src").alias("dst")), "dst", "left_anti")


def visible(nodes: DataFrame, limit: int = VISIBLE) -> DataFrame:
    """The most central nodes; expects betweenness, frequency and lemma."""
    return nodes.orderBy(F.desc("betweenness"), F.desc("frequency"), "lemma").limit(limit)


def traces(pairs: DataFrame, lemma: Column | str) -> DataFrame:
    """path, sentence and the partner concepts through which a concept's edges come from it."""
    hit = pairs.where((F.col("a") == lemma) | (F.col("b") == lemma)).where("sentence >= 0")
    other = F.when(F.col("a") == lemma, F.col("b")).otherwise(F.col("a"))
    return hit.groupBy("path", "sentence").agg(F.array_join(F.array_sort(F.collect_set(other)), " ").alias("partners"))


def literal_leaks(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, documents, first_doc: in how many documents an item's whole text occurs.

    Each text is probed by its rarest inner word, which a document that holds
    the text has as a whole word too; texts of one or two words by the
    substrings of words.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    t = items.select("item_id", F.col("text").alias("item"), split(F.col("text")).alias("w"))
    inner = t.where(F.size("w") >= 3).select("item_id", "item", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.size("w") - 2))).alias("word"))
    words = docs.select("doc_id", F.explode_outer(F.array_distinct(split(F.col("text")))).alias("word"))
    asked = words.join(inner.select("word").distinct(), "word", "left_semi")
    counts = asked.groupBy("word").agg(F.count("*").alias("df"))
    rarest = inner.join(counts, "word", "left").groupBy("item_id", "item").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    candidates = rarest.join(asked, "word").select("item_id", "item", "doc_id")
    found = candidates.join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("item")))
    found = found.select("item_id", "doc_id").unionByName(_short_leaks(t.where(F.size("w") < 3), words, docs))
    per = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    return items.select("item_id").join(per, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first_doc")


def _short_leaks(items: DataFrame, words: DataFrame, docs: DataFrame) -> DataFrame:
    """items (item_id, item, w) of one or two words: they may lie inside words. Their longest word is looked up among the substrings of its length of all distinct words."""
    longest = F.element_at(F.array_sort("w", lambda x, y: F.length(x) - F.length(y)), -1)
    probe = items.where(F.size("w") > 0).select("item_id", "item", longest.alias("probe"))
    lengths = F.broadcast(probe.select(F.length("probe").alias("n")).distinct().agg(F.collect_set("n").alias("lengths")))  # one row
    known = words.where("word IS NOT NULL").select("word").distinct().join(lengths, F.lit(True))
    parts = F.flatten(F.transform("lengths", lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring("word", i, n))).otherwise(F.array().cast("array<string>"))))
    holding = known.select("word", F.explode(F.array_distinct(parts)).alias("probe")).join(probe, "probe").select("item_id", "item", "word")
    candidates = holding.join(words, "word").select("item_id", "item", "doc_id").distinct()
    found = candidates.join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("item"))).select("item_id", "doc_id")
    blank = items.where(F.size("w") == 0).groupBy("item").agg(F.collect_list("item_id").alias("ids"))  # items of white space alone: as many rows as they are unlike
    rest = docs.join(blank, F.col("text").contains(F.col("item"))).select(F.explode("ids").alias("item_id"), "doc_id")
    return found.unionByName(rest)


def numbered(df: DataFrame, by: str, name: str = "number") -> DataFrame:
    """df with a number from 0 in the order of a column: sorted by range, numbered within partitions, and moved on by what lies in the partitions before."""
    parts = materialize(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return parts.join(starts, "_part").withColumn(name, (F.col("_start") + own - 1).cast("long")).drop("_part", "_start")
