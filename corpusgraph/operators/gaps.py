"""Community summaries, connectors, structural gaps, isolated documents, missing bridges, questions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..storage import materialize
from . import graph

MIN_SIZE, PERCENTILE, MAX_GAPS, MAX_ISOLATED, MAX_BRIDGES = 3, 25, 12, 20, 15


def connectors(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """nodes (id, lemma, frequency, betweenness) -> those far more between than frequent."""
    top = nodes.agg(F.max("betweenness").alias("mb"), F.max("frequency").alias("mf"))
    ratio = (F.col("betweenness") / F.col("mb")) / (F.col("frequency") / F.col("mf") + 0.08)
    return nodes.join(F.broadcast(top), F.col("mb") > 0).where("betweenness > 0").select("id", "lemma", "frequency", "betweenness", ratio.alias("ratio")).orderBy(F.desc("ratio"), "id").limit(limit)


def influencers(nodes: DataFrame, limit: int = 25) -> DataFrame:
    return nodes.orderBy(F.desc("betweenness"), F.desc("frequency"), "id").limit(limit)


def summaries(nodes: DataFrame) -> DataFrame:
    """nodes (id, form, frequency, betweenness, community) -> community, nodes, percentage, frequency, name."""
    r = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("betweenness"), F.desc("frequency"), "id"))
    total = nodes.agg(F.count("*").alias("all_nodes"))
    per = nodes.withColumn("r", r).groupBy("community").agg(F.count("*").alias("nodes"), F.sum("frequency").alias("frequency"), F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "form")))).alias("top"))
    return per.join(F.broadcast(total), F.col("all_nodes") > 0).select("community", "nodes", (100 * F.col("nodes") / F.col("all_nodes")).alias("percentage"), "frequency", F.array_join(F.col("top.form"), " · ").alias("name"))


def densities(nodes: DataFrame, edges: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """nodes (id, community), edges (a_id, b_id, weight) -> every pair of communities: ca < cb, na, nb, edges, density, inner_a, inner_b, global."""
    size = nodes.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    ends = edges.join(F.broadcast(nodes.select(F.col("id").alias("a_id"), F.col("community").alias("x"))), "a_id").join(F.broadcast(nodes.select(F.col("id").alias("b_id"), F.col("community").alias("y"))), "b_id")
    count = ends.groupBy(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).agg(F.count("*").alias("k"), F.sum("weight").alias("w"))
    inner = size.join(count.where("ca = cb").select(F.col("ca").alias("community"), "k"), "community", "left").select("community", "n", (F.coalesce("k", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("inner"))
    left = inner.select(F.col("community").alias("ca"), F.col("n").alias("na"), F.col("inner").alias("inner_a"))
    right = inner.select(F.col("community").alias("cb"), F.col("n").alias("nb"), F.col("inner").alias("inner_b"))
    pairs = left.join(F.broadcast(right), F.col("ca") < F.col("cb"))  # communities of the cut graph
    whole = nodes.agg(F.count("*").alias("v")).join(F.broadcast(edges.agg(F.count("*").alias("e"))), F.lit(True))
    joined = pairs.join(count.where("ca < cb"), ["ca", "cb"], "left").join(F.broadcast(whole), F.lit(True))
    return joined.select("ca", "cb", "na", "nb", F.coalesce("k", F.lit(0)).alias("edges"), (F.coalesce("k", F.lit(0)) / (F.col("na") * F.col("nb"))).alias("density"), "inner_a", "inner_b", (F.col("e") / (F.col("v") * (F.col("v") - 1) / 2)).alias("global_density"))


def structural(pairs: DataFrame, percentile: int = PERCENTILE) -> DataFrame:
    """Pairs of communities, each dense in itself, whose density with each other lies in the lowest quarter."""
    cut = pairs.agg(F.percentile("density", percentile / 100).alias("cut"))
    return pairs.join(F.broadcast(cut), F.lit(True)).where((F.col("density") <= F.col("cut")) & (F.col("inner_a") >= F.col("global_density")) & (F.col("inner_b") >= F.col("global_density"))).drop("cut")


def isolated(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """docs (path, terms), linked (path) -> documents of at least the median's terms without a dependency."""
    median = docs.where("terms > 0").agg(F.percentile("terms", 0.5).alias("median"))
    return docs.where("terms > 0").join(F.broadcast(median), F.col("terms") >= F.col("median")).join(linked.select("path").distinct(), "path", "left_anti").select("path", "terms")


def isolated_quick(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """As isolated, with the upper median of all documents."""
    counts = docs.groupBy("terms").agg(F.count("*").alias("c"))  # one row for each number of terms
    below = F.sum("c").over(Window.orderBy("terms"))
    whole = docs.agg(F.floor(F.count("*") / 2).alias("half"))
    median = counts.withColumn("below", below).join(F.broadcast(whole), F.col("below") > F.col("half")).agg(F.min("terms").alias("median"))
    return docs.join(F.broadcast(median), F.col("terms") >= F.col("median")).join(linked.select("path").distinct(), "path", "left_anti").select("path", "terms")


def seed(text: str) -> int:
    """FNV-1a of 32 bits over UTF-16 units, without its sign."""
    h = 2166136261
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return 2**32 - h if h >> 31 else h


#: A question for each kind of gap, chosen by the gap's seed; slots are named in ``structural_slots`` and its siblings.
TEMPLATES = {
    "structural": (
        "gap {a} | {b}: documents {doc_a} | {doc_b}?",
        "gap {central_a} | {central_b}: distance {distance}?",
        "gap {a} | {b}: edges {edges}, share {share}?",
        "gap {central_a} | {central_b}?",
    ),
    "isolated": ("isolated {name}: terms {terms}, near {near}?", "isolated {name}: words {words}, near {near}?", "isolated {name}: near {near}?"),
    "bridge": ("bridge {form}: {a} | {b}, documents {doc_a} | {doc_b}?", "bridge {form}: {a} | {b}?", "bridge {form}?"),
}
#: Of the structural templates: the one that names a distance, and the one that stands for it where there is no way.
WITH_DISTANCE, WITHOUT_WAY = 1, 3


def short_name(path: str | None) -> str:
    import re

    return re.sub(r"\.[A-Za-z0-9]{1,10}$", "", path.rsplit("/", 1)[-1]) if path else "-"


def listing(terms: list[str] | None, count: int = 3) -> str:
    return ", ".join(list(terms or [])[:count]) or "-"


def structural_slots(g: dict) -> tuple[str, dict]:
    """The seed's text and the slots of a structural gap."""
    a, b = g["central_a"] or listing(g["terms_a"], 1), g["central_b"] or listing(g["terms_b"], 1)
    docs = [short_name((g[f"docs_{x}"] or [None])[0]) for x in "ab"]
    slots = {"a": listing(g["terms_a"]), "b": listing(g["terms_b"]), "central_a": a, "central_b": b, "doc_a": docs[0], "doc_b": docs[1]}
    return f"e:{g['ca']}:{g['cb']}:{a}{b}", slots | {"distance": g["distance"], "edges": g["edges"], "share": f"{int(g['weight'] * 100 + 0.5)}%"}


def isolated_slots(d: dict) -> tuple[str, dict]:
    return f"a:{d['path']}", {"name": short_name(d["path"]), "terms": d["terms"], "words": d["words"], "near": listing([short_name(p) for p in d["affine"] or []], 2)}


def bridge_slots(p: dict) -> tuple[str, dict]:
    docs = [short_name((p[f"docs_{x}"] or [None])[0]) for x in "ab"]
    return f"p:{p['lemma']}{p['community_a']}{p['community_b']}", {"form": p["form"], "a": listing(p["near_a"], 2), "b": listing(p["near_b"], 2), "doc_a": docs[0], "doc_b": docs[1]}


_SLOTS = {"structural": structural_slots, "isolated": isolated_slots, "bridge": bridge_slots}


def question(kind: str, gap: dict, templates: dict = TEMPLATES) -> tuple[int, str]:
    """The template's number and the question; the same gap always gets the same one."""
    text, slots = _SLOTS[kind](gap)
    k = seed(text) % len(templates[kind])
    if kind == "structural" and k == WITH_DISTANCE and slots["distance"] is None:
        k = WITHOUT_WAY
    return k, templates[kind][k].format(**slots)


def question_of(templates: dict):
    """kind, the gap as JSON -> its question."""

    @F.pandas_udf(StructType([StructField("template", IntegerType()), StructField("question", StringType())]))
    def asked(kind: pd.Series, gap: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([question(k, json.loads(g), templates) for k, g in zip(kind, gap)], columns=["template", "question"])

    return asked


def central(nodes: DataFrame) -> DataFrame:
    """community, id, form of its most central node: by betweenness, then frequency, then the smaller id."""
    order = F.struct("betweenness", "frequency", -F.col("id"))
    return nodes.groupBy("community").agg(F.max_by("id", order).alias("id"), F.max_by("form", order).alias("form"))


def side_terms(nodes: DataFrame, count: int = 6) -> DataFrame:
    """community, terms: the forms of its most central nodes."""
    r = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("betweenness"), F.desc("frequency"), "id"))
    few = nodes.withColumn("r", r).where(F.col("r") <= count)
    return few.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "form"))), lambda x: x["form"]).alias("terms"))


def side_documents(nodes: DataFrame, postings: DataFrame, count: int = 3) -> DataFrame:
    """community, documents: the paths that hold most of its concepts (postings: lemma, path)."""
    hits = postings.select("lemma", "path").distinct().join(F.broadcast(nodes.select("lemma", "community")), "lemma").groupBy("community", "path").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "path"))
    few = hits.withColumn("r", r).where(F.col("r") <= count)
    return few.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("documents"))


def _for_sides(table: DataFrame, value: str, name: str) -> list[DataFrame]:
    return [table.select(F.col("community").alias(f"c{x}"), F.col(value).alias(f"{name}_{x}")) for x in "ab"]


def structural_gaps(nodes: DataFrame, edges: DataFrame, postings: DataFrame, min_inner: float = 0.0, percentile: int = PERCENTILE, limit: int | None = MAX_GAPS) -> DataFrame:
    """The gaps between communities of the cut graph, whole: nodes (id, lemma, form, frequency, betweenness, community), edges (a_id, b_id, weight), postings (lemma, path).

    A row per gap: ca, cb, na, nb, edges, density, inner_a, inner_b, distance
    (null: no way) between the central nodes, weight (share of all
    frequencies), ease, score, central_a, central_b, terms_a, terms_b, docs_a,
    docs_b. A graph of under four nodes has none.
    """
    pairs = densities(nodes, edges)
    pairs = structural(pairs.withColumn("global_density", F.greatest("global_density", F.lit(float(min_inner)))), percentile)
    whole = nodes.agg(F.sum("frequency").alias("all_frequency"), F.count("*").alias("v")).where("v >= 4")
    freq, mid = nodes.groupBy("community").agg(F.sum("frequency").alias("f")), materialize(central(nodes), "central")
    far = graph.distances(edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), mid.select(F.col("id").alias("source")))
    out = pairs.join(F.broadcast(whole), F.lit(True))  # one row
    for table, value, name in ((freq, "f", "f"), (mid, "id", "id"), (mid, "form", "central"), (side_terms(nodes), "terms", "terms"), (side_documents(nodes, postings), "documents", "docs")):
        for side in _for_sides(table, value, name):
            out = out.join(side, side.columns[0], "left")
    out = out.join(far.select(F.col("source").alias("id_a"), F.col("node").alias("id_b"), F.col("hops").alias("distance")), ["id_a", "id_b"], "left")
    weight = (F.col("f_a") + F.col("f_b")) / F.greatest("all_frequency", F.lit(1))
    ease = F.when(F.col("distance").isNull(), 1 / 12).otherwise(1 / F.greatest("distance", F.lit(1)))
    out = out.withColumns({"weight": weight, "ease": ease}).withColumn("score", F.col("weight") * F.col("ease"))
    out = out.select("ca", "cb", "na", "nb", "edges", "density", "inner_a", "inner_b", "distance", "weight", "ease", "score", "central_a", "central_b", "terms_a", "terms_b", "docs_a", "docs_b")
    return out if limit is None else out.orderBy(F.desc("score"), "ca", "cb").limit(limit)


def isolated_documents(docs: DataFrame, dependencies: DataFrame, affinities: DataFrame, limit: int | None = MAX_ISOLATED) -> DataFrame:
    """docs (path, state, terms, words), dependencies (a, b), affinities (a, b, cosine) -> path, terms, words, affine (up to three, nearest first), score: rich documents that nothing depends on."""
    read = docs.where("state = 'ok' AND terms > 0")
    linked = dependencies.select(F.col("a").alias("path")).union(dependencies.select("b")).distinct()
    alone = isolated(read.select("path", "terms"), linked).join(read.select("path", "words"), "path")
    alone = materialize(alone, "alone")
    both = F.explode(F.array(F.struct(F.col("a").alias("path"), F.col("b").alias("near")), F.struct(F.col("b").alias("path"), F.col("a").alias("near"))))
    ends = affinities.select("cosine", both.alias("e")).select("e.path", "e.near", "cosine")  # not a union, which would derive the pairs twice
    ends = ends.join(F.broadcast(alone.select("path")), "path", "left_semi")  # a path for each document at most
    r = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("cosine"), "near"))
    near = ends.withColumn("r", r).where("r <= 3").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "near"))), lambda x: x["near"]).alias("affine"))
    out = alone.join(near, "path", "left").withColumn("affine", F.coalesce("affine", F.array().cast("array<string>")))
    out = out.withColumn("score", F.col("terms") * F.when(F.size("affine") > 0, 1.0).otherwise(1.5)).select("path", "terms", "words", "affine", "score")
    return out if limit is None else out.orderBy(F.desc("score"), "path").limit(limit)


def gap_questions(structural_rows: DataFrame, isolated_rows: DataFrame, bridge_rows: DataFrame, templates: dict = TEMPLATES) -> DataFrame:
    """kind, key, score, template, question for the three kinds of gaps. templates: for each kind, texts with slots; four, three and three by default."""
    parts = []
    for kind, rows, key in (("structural", structural_rows, F.concat_ws(":", "ca", "cb")), ("isolated", isolated_rows, F.col("path")), ("bridge", bridge_rows, F.col("lemma"))):
        parts.append(rows.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.col("score").cast("double").alias("score"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("gap")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("q", question_of(templates)("kind", "gap")).select("kind", "key", "score", "q.template", "q.question")


def missing_bridges(nodes: DataFrame, edges: DataFrame, postings: DataFrame, reviewed: int = 400, min_docs: int = 2, limit: int | None = MAX_BRIDGES, details: bool = False) -> DataFrame:
    """Concepts between two communities that no document of theirs joins.

    nodes (id, lemma, betweenness, community), edges (a_id, b_id), postings
    (lemma, path). For each of the most central concepts, the two communities
    with most of its neighbours are its sides; a bridge is missing where both
    sides occur in its documents, but never in the same one. Ties of sides go
    to the smaller community. With details, form, near_a, near_b (five neighbours)
    and docs_a, docs_b (three documents) stand for the counts.
    """
    ends = edges.where("a_id <> b_id").select(F.col("a_id").alias("id"), F.col("b_id").alias("near"))
    ends = ends.unionByName(ends.select(F.col("near").alias("id"), F.col("id").alias("near")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    forms = nodes.select("id", "form") if "form" in nodes.columns else nodes.select("id", F.col("lemma").alias("form"))
    nodes = nodes.select("id", "lemma", "betweenness", "community")
    central = nodes.join(degree, "id").where("degree >= 2 AND betweenness > 0").orderBy(F.desc("betweenness"), "id").limit(reviewed).select("id", "lemma", "betweenness")
    central = materialize(central, "central")
    near = ends.join(F.broadcast(central.select("id")), "id").join(F.broadcast(nodes.select(F.col("id").alias("near"), F.col("lemma").alias("near_lemma"), "community")), "near")
    sides = near.groupBy("id", "community").agg(F.count("*").alias("n")).withColumn("side", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "community"))).where("side <= 2")
    both = sides.groupBy("id").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max(F.when(F.col("side") == 1, F.col("community"))).alias("community_a"), F.max(F.when(F.col("side") == 2, F.col("community"))).alias("community_b")).where("k = 2")
    asked = materialize(near.join(sides.select("id", "community", "side"), ["id", "community"]).select("id", "side", F.col("near_lemma").alias("lemma")), "asked")
    named = asked.select("lemma").union(central.select("lemma")).distinct()
    held = materialize(postings.join(F.broadcast(named), "lemma", "left_semi").select("lemma", "path").distinct(), "held")
    own = held.join(F.broadcast(central), "lemma").select("id", "path")
    # a path's central concepts meet its own lemmas, not every path of a lemma all that ask for it
    seen = own.join(held, "path").join(F.broadcast(asked), ["id", "lemma"]).select("id", "path", "side").distinct()
    enough = own.groupBy("id").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("id")
    per = seen.groupBy("id", "path").agg(F.count("*").alias("sides"), F.min("side").alias("first")).groupBy("id").agg(F.count_if(F.col("sides") == 2).alias("joint"), F.count_if(F.col("first") == 1).alias("docs_a"), F.count_if((F.col("first") == 2) | (F.col("sides") == 2)).alias("docs_b"))
    found = per.where("joint = 0 AND docs_a > 0 AND docs_b > 0").join(both, "id").join(enough, "id", "left_semi").join(central, "id")
    out = found.select("id", "lemma", "community_a", "community_b", "docs_a", "docs_b", (F.col("betweenness") * F.col("least")).alias("score"))
    if not details:
        return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)
    first = lambda df, value, n: df.groupBy("id", "side").agg(F.slice(F.array_sort(F.collect_set(value)), 1, n).alias("x"))
    around = near.join(sides.select("id", "community", "side"), ["id", "community"]).join(forms.select(F.col("id").alias("near"), F.col("form").alias("near_form")), "near")
    out = out.drop("docs_a", "docs_b").join(forms, "id")
    for df, value, n, name in ((around, "near_form", 5, "near"), (seen, "path", 3, "docs")):
        few = first(df, value, n)
        for k, x in ((1, "a"), (2, "b")):
            out = out.join(few.where(F.col("side") == k).select("id", F.col("x").alias(f"{name}_{x}")), "id", "left")
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def gap_report(nodes: DataFrame, edges: DataFrame, postings: DataFrame, docs: DataFrame, dependencies: DataFrame, affinities: DataFrame, percentile: int = PERCENTILE, reviewed: int = 400, min_docs: int = 2, limits: tuple = (MAX_GAPS, MAX_ISOLATED, MAX_BRIDGES), templates: dict = TEMPLATES) -> DataFrame:
    """All gaps in one table: kind, rank, key, score, template, question, total (of its kind, before the limit) and the parameters that gave them."""
    found = {
        "structural": structural_gaps(nodes, edges, postings, percentile=percentile, limit=None),
        "isolated": isolated_documents(docs, dependencies, affinities, limit=None),
        "bridge": missing_bridges(nodes, edges, postings, reviewed, min_docs, limit=None, details=True),
    }
    asked = materialize(gap_questions(*found.values(), templates=templates), "gaps")
    total = asked.groupBy("kind").agg(F.count("*").alias("total"))
    most = F.create_map(*[F.lit(x) for pair in zip(found, limits, strict=True) for x in pair])
    r = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "key"))
    rows = asked.withColumn("rank", r).where(F.col("rank") <= most[F.col("kind")]).join(F.broadcast(total), "kind")
    parameters = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in (("percentile", percentile), ("reviewed", reviewed), ("min_docs", min_docs))]))
    return rows.select("kind", "rank", "key", "score", "template", "question", "total", parameters.alias("parameters"))


def topic_overview(nodes: DataFrame, postings: DataFrame, terms: int = 8, paths: int = 50) -> DataFrame:
    """nodes (id, lemma, form, frequency, betweenness, community), postings (lemma, path) -> community, nodes, documents, terms.

    Documents are counted among each concept's first ``paths``; terms are the most central concepts with their frequencies.
    """
    first = F.row_number().over(Window.partitionBy("lemma").orderBy("path"))
    held = postings.join(nodes.select("lemma", "community"), "lemma").withColumn("o", first).where(F.col("o") <= paths)
    documents = held.select("community", "path").distinct().groupBy("community").agg(F.count("*").alias("documents"))
    r = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("betweenness"), F.desc("frequency"), "id"))
    named = F.when(F.col("r") <= terms, F.struct("r", F.concat("form", F.lit(" "), F.col("frequency").cast("string")).alias("text")))
    per = nodes.withColumn("r", r).groupBy("community").agg(F.count("*").alias("nodes"), F.array_sort(F.collect_list(named)).alias("top"))
    return per.join(documents, "community").select("community", "nodes", "documents", F.array_join(F.col("top.text"), " | ").alias("terms"))


def summary_slices(dependencies: DataFrame, affinities: DataFrame, unresolved: DataFrame, limits: tuple = (60, 60, 40)) -> DataFrame:
    """dependencies (a, b, weight), affinities (a, b, cosine), unresolved (a, b) -> kind, rank, a, b, weight: the first of each kind."""
    tables = (
        ("dependency", dependencies.select("a", "b", F.col("weight").cast("double").alias("weight"))),
        ("affinity", affinities.select("a", "b", F.col("cosine").alias("weight"))),
        ("unresolved", unresolved.select("a", "b", F.lit(None).cast("double").alias("weight"))),
    )
    out = None
    for (kind, rows), limit in zip(tables, limits, strict=True):
        order = [F.desc("weight"), F.col("a"), F.col("b")]
        few = rows.orderBy(*order).limit(limit)
        part = few.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "a", "b", "weight")  # at most limit rows
        out = part if out is None else out.unionByName(part)
    return out
