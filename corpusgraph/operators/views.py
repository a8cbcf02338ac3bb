"""List views, filters and layers over an index of documents and over built graphs; differences between two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import base_name, folder
from .lookup import numbered

LISTED, AFFINE, HITS, CONCEPTS, MEMBER = 300, 200, 60, 14, 0.6
SNAP_NODES, SNAP_EDGES, SNAP_WORDS = 500, 2500, 300
# fixed values: the states of a document, the worst first, and the columns of a light index
PROBLEMS = ("error", "no text", "metadata only")
STATES = ("ok", *PROBLEMS)
LIGHT = ("path", "name", "ext", "size", "modified_ms", "hash", "state", "parser", "language", "sentences", "tokens", "words", "truncated", "terms", "error")


def light(index: DataFrame) -> DataFrame:
    """An index without its texts: terms becomes their number."""
    return index.select(*[(F.size("terms") if c == "terms" else F.col(c)).alias(c) for c in LIGHT if c in index.columns])


def statistics(index: DataFrame) -> DataFrame:
    """One row: documents, words, bytes, and how many documents are in each of the fixed states."""
    states = [F.count_if(F.col("state") == s).alias(s.replace(" ", "_")) for s in STATES]
    return index.agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.sum("size").alias("bytes"), *states)


def filtered(nodes: DataFrame, ext: str | None = None, since_ms: int | None = None, search: str | None = None) -> DataFrame:
    """Nodes of a map: the extension holds for nodes with a path only, the search looks into form, lemma and path."""
    out = nodes
    if ext is not None and "path" in nodes.columns:
        out = out.where(F.col("path").isNull() | (F.col("ext") == ext))
    if since_ms is not None and "modified_ms" in nodes.columns:
        out = out.where(F.col("modified_ms").isNull() | (F.col("modified_ms") >= since_ms))
    return out if not search else out.where(found_in(nodes.columns, search))


def found_in(columns: list[str], search: str) -> Column:
    texts = [F.coalesce(F.lower(F.col(c)).contains(search.lower()), F.lit(False)) for c in ("form", "lemma", "path") if c in columns]
    out = texts[0]
    for t in texts[1:]:
        out = out | t
    return out


def search_hits(nodes: DataFrame, search: str) -> DataFrame:
    """Which visible nodes a search lights up, and how many they are; an empty search lights none."""
    hits = nodes.where(found_in(nodes.columns, search)) if search else nodes.where(F.lit(False))
    return hits.join(F.broadcast(hits.agg(F.count("*").alias("hits"))), F.lit(True))  # one row


def slider(index: DataFrame, fraction: float) -> DataFrame:
    """The date that a slider's fraction stands for: one row with oldest, newest and cutoff."""
    ends = index.where("modified_ms > 0").agg(F.min("modified_ms").alias("oldest"), F.max("modified_ms").alias("newest"))
    return ends.withColumn("cutoff", F.floor(F.col("oldest") + (F.col("newest") - F.col("oldest")) * F.lit(float(fraction))))


def listed(index: DataFrame, search: str = "", limit: int | None = LISTED) -> DataFrame:
    """The inventory's rows: part of a path, .ext, or the extension itself; the latest first."""
    s = search.strip().lower()
    hit = F.lower("path").contains(s) | (F.concat(F.lit("."), "ext") == s) | (F.col("ext") == s) if s else F.lit(True)
    out = index.where(hit).orderBy(F.desc("modified_ms"), "path")
    return out if limit is None else out.limit(limit)


def problems(index: DataFrame) -> DataFrame:
    """Documents that could not be read, with their state's rank."""
    rank = F.lit(len(PROBLEMS))
    for k, state in enumerate(PROBLEMS):
        rank = F.when(F.col("state") == state, k).otherwise(rank)
    return index.where("state <> 'ok'").withColumn("rank", rank)


def affine(pairs: DataFrame, threshold: float, limit: int = AFFINE) -> DataFrame:
    return pairs.where(F.col("cosine") >= threshold).orderBy(F.desc("cosine"), "a", "b").limit(limit)


def least_weight(visible: Column, scale: Column) -> Column:
    """The lightest edge that is drawn among so many nodes at a scale."""
    many = F.when(scale < 0.35, 3.0).when(scale < 0.8, 2.0).when(scale < 1.6, 1.2).otherwise(0.0)
    some = F.when(scale < 0.5, 1.5).otherwise(0.0)
    return F.when(visible > 400, many).when(visible > 120, some).otherwise(0.0)


def concepts_of(members: DataFrame, nodes: DataFrame, limit: int = CONCEPTS) -> DataFrame:
    """members (path, lemma), nodes (lemma, id, form) -> each document's first concepts in the order of the graph."""
    r = F.row_number().over(Window.partitionBy("path").orderBy("id"))
    found = members.join(F.broadcast(nodes.select("lemma", "id", "form")), "lemma")  # nodes of the cut graph
    return found.withColumn("place", r).where(F.col("place") <= limit).select("path", "place", "id", "form")


def document_layer(dependencies: DataFrame, affinities: DataFrame) -> DataFrame:
    """a, b, kind, weight: what is drawn between documents."""
    drawn = affinities.select("a", "b", F.lit("affinity").alias("kind"), F.col("cosine").alias("weight"))
    return dependencies.select("a", "b", "kind", F.col("weight").cast("double").alias("weight")).unionByName(drawn)


def folder_groups(paths: DataFrame) -> DataFrame:
    """path -> path, community: the number of its folder, in the order in which folders first appear by path."""
    parent = F.regexp_replace(folder(F.col("path")), "/$", "")
    own = paths.select("path", parent.alias("folder"))
    first = own.groupBy("folder").agg(F.min("path").alias("first"))
    return own.join(numbered(first, "first", "community"), "folder").select("path", "folder", "community")


def mixed_edges(concepts: DataFrame, dependencies: DataFrame, members: DataFrame, documents: DataFrame, shift: int) -> DataFrame:
    """Edges of the mixed layer by id: concepts (a_id, b_id, weight), dependencies (a, b, kind, weight by path), members (path, concept); documents (path, id) follow the concepts."""
    place = documents.select("path", (F.col("id") + shift).alias("id"))
    ends = dependencies.join(place.withColumnsRenamed({"path": "a", "id": "x"}), "a").join(place.withColumnsRenamed({"path": "b", "id": "y"}), "b")
    parts = [
        concepts.select(F.col("a_id").cast("long").alias("a"), F.col("b_id").cast("long").alias("b"), F.lit(None).cast("string").alias("kind"), F.col("weight").cast("double").alias("weight")),
        ends.select(F.col("x").alias("a"), F.col("y").alias("b"), "kind", F.col("weight").cast("double").alias("weight")),
        members.join(place, "path").select(F.col("concept").cast("long").alias("a"), F.col("id").alias("b"), F.lit("member").alias("kind"), F.lit(MEMBER).alias("weight")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def all_lemmas(terms: DataFrame, path_terms: DataFrame) -> DataFrame:
    """The lemmas of texts and of paths, each once."""
    return terms.select("lemma").union(path_terms.select("lemma")).distinct()


def named_partners(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges by id with the paths of both ends."""
    left, right = (names.select(F.col("id").alias(x), F.col("path").alias(y)) for x, y in (("a", "from_path"), ("b", "to_path")))
    return edges.join(left, "a").join(right, "b").drop("a", "b")


def state_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two states of an index (path, hash, words) -> path, change (new, modified, deleted), delta of words."""
    old = before.select("path", F.col("hash").alias("old_hash"), F.col("words").alias("old_words"), F.lit(1).alias("old"))
    new = after.select("path", F.col("hash").alias("new_hash"), F.col("words").alias("new_words"), F.lit(1).alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    both = old.join(new, "path", "full_outer").withColumn("change", change).where("change IS NOT NULL")
    return both.select("path", "change", (F.coalesce("new_words", F.lit(0)) - F.coalesce("old_words", F.lit(0))).alias("delta"))


def lemma_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """lemma, change: first and last appearance of a lemma in the corpus."""
    old, new = before.select("lemma").distinct(), after.select("lemma").distinct()
    gone = old.join(new, "lemma", "left_anti").withColumn("change", F.lit("gone"))
    return new.join(old, "lemma", "left_anti").withColumn("change", F.lit("new")).unionByName(gone)


def snapshot_nodes(nodes: DataFrame, limit: int = SNAP_NODES) -> DataFrame:
    """The most central nodes with new numbers from 0: what a snapshot keeps."""
    order = [F.desc("betweenness"), F.desc("frequency"), F.col("id")]
    few = nodes.orderBy(*order).limit(limit)
    return few.withColumn("number", F.row_number().over(Window.orderBy(*order)) - 1)  # at most limit rows


def snapshot_edges(edges: DataFrame, kept: DataFrame, limit: int = SNAP_EDGES) -> DataFrame:
    """The heaviest edges (a_id, b_id, weight) between kept nodes, under their new numbers."""
    a, b = (F.broadcast(kept.select(F.col("id").alias(f"{x}_id"), F.col("number").alias(x))) for x in ("a", "b"))
    return edges.select("a_id", "b_id", "weight").join(a, "a_id").join(b, "b_id").orderBy(F.desc("weight"), "a_id", "b_id").limit(limit).select("a", "b", "weight")


def short_name(path: Column) -> Column:
    """A path's last part without extension; nothing stands for any document."""
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("un documento")).otherwise(F.regexp_replace(base_name(path), r"\.[A-Za-z0-9]{1,10}$", ""))


def stamp(date: Column, with_time: bool = True) -> Column:
    """A date as year, month, day, and hour and minute."""
    return F.date_format(date, "yyyy-MM-dd HH:mm" if with_time else "yyyy-MM-dd")


def bounding_box(points: DataFrame) -> DataFrame:
    """Points (x, y, visible) -> one row around the visible ones."""
    return points.where("visible").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def nearest(points: DataFrame, x: float, y: float, slack: float = 0.0) -> DataFrame:
    """The visible point (id, x, y, radius) whose circle, widened by slack, holds a place and whose middle is nearest; no row where none does."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    inside = points.where("visible").withColumn("d2", d2).where(F.col("d2") <= (F.col("radius") + slack) * (F.col("radius") + slack))
    return inside.orderBy("d2", "id").limit(1).select("id", "d2")

