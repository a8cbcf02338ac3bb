"""The concept layer: term frequencies, nodes, co-occurrence edges, cuts, vocabulary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import text as tx
from ..storage import materialize, spread

WINDOW, SAME, CROSS, SAMPLES = 4, 10, 4, 3  # weights in tenths, so that sums are exact in any order
MAX_NODES, MIN_FREQUENCY, MIN_WEIGHT, MIN_DOCS, TOP_TERMS, PATHS = 3000, 2, 10, 1, 400, 50


def analyzed(docs: DataFrame, extra_stop: Iterable[str] = ()) -> DataFrame:
    """path, text -> path, detected, tokens: one row per document, nothing shuffled."""
    return batches.with_tokens(docs.select("path", "text"), extra_stop)


def stored_analysis(docs: DataFrame, extra_stop: Iterable[str] = ()) -> DataFrame:
    """analyzed, derived once and kept in the shared folder: where nodes and edges, or terms and nodes, start from the same tokens."""
    return materialize(analyzed(spread(docs.select("path", "text")), extra_stop), "analysis")


def exploded(analysis: DataFrame) -> DataFrame:
    """path, detected, tokens -> path, detected, pos, lemma, form, sentence."""
    # outer, as an inner explode would derive the tokens a second time in a filter of its own
    return analysis.select("path", "detected", F.posexplode_outer("tokens").alias("pos", "t")).where("t IS NOT NULL").select("path", "detected", "pos", "t.*")


def token_rows(docs: DataFrame, extra_stop: Iterable[str] = ()) -> DataFrame:
    """path, detected, pos, lemma, form, sentence."""
    return exploded(analyzed(spread(docs.select("path", "text")), extra_stop))


def term_frequencies(rows: DataFrame, top: int | None = None) -> DataFrame:
    """path, lemma, form (most used, first seen), n, rank by n and lemma."""
    forms = rows.groupBy("path", "lemma", "form").agg(F.count("*").alias("k"), F.min("pos").alias("seen"))
    terms = forms.groupBy("path", "lemma").agg(F.max_by("form", F.struct("k", -F.col("seen"))).alias("form"), F.sum("k").alias("n"))
    ranked = terms.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "lemma")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def concept_nodes(rows: DataFrame) -> DataFrame:
    """lemma, form, frequency, docs; ties of forms go to the first path and place."""
    forms = rows.groupBy("lemma", "form").agg(F.count("*").alias("k"), F.min(F.struct("path", "pos")).alias("seen"))
    best = Window.partitionBy("lemma").orderBy(F.desc("k"), "seen")
    top = forms.withColumn("r", F.row_number().over(best)).where("r = 1").select("lemma", "form")
    totals = rows.groupBy("lemma", "path").agg(F.count("*").alias("k")).groupBy("lemma").agg(F.sum("k").alias("frequency"), F.count("*").alias("docs"))
    return totals.join(top, "lemma")


def pair_rows(analysis: DataFrame, window: int = WINDOW) -> DataFrame:
    """path, tokens -> a row per pair at distance below window: path, a, b (a < b), tenths, sentence of the left token. No shuffle."""
    t, n = F.col("tokens"), F.size("tokens")
    zipped = []
    for d in range(1, window):
        left, right = F.slice(t, F.lit(1), F.greatest(n - d, F.lit(0))), F.slice(t, F.lit(1 + d), F.greatest(n - d, F.lit(0)))
        zipped.append(F.zip_with(left, right, lambda x, y: F.struct(F.least(x["lemma"], y["lemma"]).alias("a"), F.greatest(x["lemma"], y["lemma"]).alias("b"), F.when(x["sentence"] == y["sentence"], SAME).otherwise(CROSS).alias("tenths"), x["sentence"].alias("sentence"))))
    return analysis.select("path", F.explode_outer(F.concat(*zipped)).alias("p")).where("p.a <> p.b").select("path", "p.*")


def concept_edges(pairs: DataFrame) -> DataFrame:
    """a, b, tenths, docs: aggregated by document before the pair, so that nothing distinct is counted."""
    return pairs.groupBy("a", "b", "path").agg(F.sum("tenths").alias("w")).groupBy("a", "b").agg(F.sum("w").alias("tenths"), F.count("*").alias("docs"))


def edge_samples(pairs: DataFrame, limit: int = SAMPLES) -> DataFrame:
    """a, b, path, sentence, sample: the first few places of each edge. A document's places of a pair are cut to the first few before they meet those of others."""
    first = lambda places: F.slice(F.array_sort(places), 1, limit)
    own = pairs.groupBy("a", "b", "path").agg(first(F.collect_set("sentence")).alias("s"))
    nearest = F.row_number().over(Window.partitionBy("a", "b").orderBy("path"))
    few = own.withColumn("r", nearest).where(F.col("r") <= limit).select("a", "b", "path", F.explode("s").alias("sentence"))
    places = few.groupBy("a", "b").agg(first(F.collect_list(F.struct("path", "sentence"))).alias("s"))
    return places.select("a", "b", F.posexplode("s").alias("sample", "x")).select("a", "b", "x.path", "x.sentence", (F.col("sample") + 1).alias("sample"))


def path_cliques(paths: DataFrame) -> DataFrame:
    """path -> pairs of its terms for documents without text: path, a, b, tenths, sentence -1."""
    t = F.array_distinct(tx.path_terms(F.col("path")))
    both = paths.select("path", t.alias("t")).select("path", "t", F.explode("t").alias("x")).select("path", "x", F.explode("t").alias("y"))
    return both.where("x < y").select("path", F.col("x").alias("a"), F.col("y").alias("b"), F.lit(CROSS).alias("tenths"), F.lit(-1).alias("sentence"))


def path_rows(paths: DataFrame) -> DataFrame:
    """path -> path, pos, lemma, form: documents without text count with each distinct term of their path once."""
    t = F.array_distinct(tx.path_terms(F.col("path")))
    return paths.select("path", F.posexplode(t).alias("pos", "lemma")).select("path", "pos", "lemma", F.col("lemma").alias("form"))


def cut_nodes(nodes: DataFrame, min_frequency: int = MIN_FREQUENCY, min_docs: int = MIN_DOCS, max_nodes: int = MAX_NODES) -> DataFrame:
    """The most frequent concepts, numbered from 0: at most max_nodes rows."""
    kept = nodes.where((F.col("frequency") >= min_frequency) & (F.col("docs") >= min_docs)).orderBy(F.desc("frequency"), F.desc("docs"), "lemma").limit(max_nodes)
    return kept.withColumn("id", F.row_number().over(Window.orderBy(F.desc("frequency"), F.desc("docs"), "lemma")) - 1)


def cut_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of two kept concepts: where edges are cut anyway, the others need not be counted. Spark broadcasts the kept ones where they are small enough."""
    a, b = (nodes.select(F.col("lemma").alias(x)) for x in ("a", "b"))
    return pairs.join(a, "a", "left_semi").join(b, "b", "left_semi")


def cut_edges(edges: DataFrame, nodes: DataFrame, min_tenths: int = MIN_WEIGHT) -> DataFrame:
    """Edges between kept concepts; Spark broadcasts these where they are small enough, as the usual cut is."""
    a, b = (nodes.select(F.col("lemma").alias(x), F.col("id").alias(f"{x}_id")) for x in ("a", "b"))
    return edges.where(F.col("tenths") >= min_tenths).join(a, "a").join(b, "b").withColumn("weight", F.col("tenths") / 10)


def vocabulary(rows: DataFrame) -> DataFrame:
    """lemma, doc_count."""
    return rows.select("path", "lemma").distinct().groupBy("lemma").agg(F.count("*").alias("doc_count"))


def vocabulary_update(counts: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """lemma, doc_count after documents' lemma sets (path, lemma) went and came."""
    deltas = counts.unionByName(removed.distinct().select("lemma", F.lit(-1).cast("long").alias("doc_count"))).unionByName(added.distinct().select("lemma", F.lit(1).cast("long").alias("doc_count")))
    return deltas.groupBy("lemma").agg(F.sum("doc_count").alias("doc_count")).where("doc_count > 0")


def _own(docs: DataFrame):
    """The counts within tasks, where every document has a path of its own."""
    from . import tallies

    return tallies if tallies.own_paths(docs) else None


def document_terms(docs: DataFrame, top: int) -> DataFrame:
    """path, text -> path, lemma, form, n, rank: term_frequencies of the documents."""
    own = _own(docs)
    return own.terms(docs, top) if own else term_frequencies(token_rows(docs), top)


def document_nodes(docs: DataFrame) -> DataFrame:
    """path, text -> lemma, form, frequency, docs: concept_nodes of the documents."""
    own = _own(docs)
    return own.nodes(docs) if own else concept_nodes(token_rows(docs))


def document_edges(docs: DataFrame) -> DataFrame:
    """path, text -> a, b, tenths, docs: concept_edges of the documents."""
    own = _own(docs)
    return own.edges(docs) if own else concept_edges(pair_rows(stored_analysis(docs)))


def document_samples(docs: DataFrame) -> DataFrame:
    """path, text -> a, b, path, sentence, sample: edge_samples of the documents."""
    own = _own(docs)
    return own.edge_samples(docs, SAMPLES) if own else edge_samples(pair_rows(stored_analysis(docs)))


def document_cut(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, text -> the kept nodes and their edges, each written; the kept lemmas, at most MAX_NODES, go to all tasks."""
    own = _own(docs)
    nodes = materialize(cut_nodes(own.nodes(docs) if own else concept_nodes(token_rows(docs))), "nodes")
    if own:
        return nodes, materialize(cut_edges(own.edges(docs, [r.lemma for r in nodes.select("lemma").collect()]), nodes), "edges")
    return nodes, materialize(cut_edges(concept_edges(cut_pairs(pair_rows(analyzed(spread(docs.select("path", "text")))), nodes)), nodes), "edges")


def lemma_counts(docs: DataFrame) -> DataFrame:
    """path, text -> path, terms: how many lemmas each document with tokens has."""
    own = _own(docs)
    return own.lemma_counts(docs) if own else token_rows(docs).select("path", "lemma").distinct().groupBy("path").agg(F.count("*").alias("terms"))
