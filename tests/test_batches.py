"""The batch analysis and the counts within tasks against the expressions and groupings they stand for."""

import random

from pyspark.sql import functions as F

from corpusgraph.functions import batches
from corpusgraph.functions import text as tx
from corpusgraph.operators import concepts as co
from corpusgraph.operators import tallies

BITS = ["Dr. ", "Sr.\n\n", "p. ej. ", "no.  ", "et al. ", "-no. ", "ñno. ", " ", "\n\n", "\n\n\n", "_", "ſ", "K", "İ", "ΑΣ ", "Ñandú", "é", "·", "-", "'", "… ", "?! ", ". ", "\u0085", "\xa0", "\x02", "\x03", "12", "running ", "stopped ", "cities ", "analysis ", "canciones ", "lentamente ", "peces ", "the ", "de ", "la ", "of ", "el ", "to ", "y ", "日本語", "Ⅷ", "²"]


def _texts():
    rnd = random.Random(7)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 90))) for _ in range(300)] + [None, "", " ", "the of " * 4000 + "de la " * 9000]


def _docs(spark):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(_texts())], "path string, text string")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_batches_give_the_tokens_of_the_expressions(spark):
    docs = _docs(spark)
    known = docs.select("path", "text", tx.language(F.col("text")).alias("detected"))
    assert _rows(batches.with_tokens(docs)) == _rows(known.select("path", "detected", tx.tokens(F.col("text"), F.col("detected")).alias("tokens")))


def test_counts_within_tasks(spark, monkeypatch):
    monkeypatch.setattr(tallies, "HELD", 50)
    monkeypatch.setattr(batches, "ROWS", 40)
    docs = _docs(spark)
    analysis = co.analyzed(docs)
    rows = co.exploded(analysis)
    assert tallies.own_paths(docs)
    assert _rows(tallies.terms(docs, 5)) == _rows(co.term_frequencies(rows, 5).select("path", "lemma", "form", "n", "rank"))
    assert _rows(tallies.nodes(docs)) == _rows(co.concept_nodes(rows).select("lemma", "form", "frequency", "docs"))
    assert _rows(tallies.edges(docs)) == _rows(co.concept_edges(co.pair_rows(analysis)))
    samples = tallies.edge_samples(docs, 3)
    assert _rows(samples) == _rows(co.edge_samples(co.pair_rows(analysis)).select("a", "b", "path", "sentence", "sample"))
    assert tallies.edge_samples(docs, 3)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # a pair's places are shuffled once
    assert _rows(tallies.lemma_counts(docs)) == _rows(rows.select("path", "lemma").distinct().groupBy("path").agg(F.count("*").alias("terms")))


def test_shared_and_missing_paths_are_counted_once(spark):
    docs = spark.createDataFrame([("a", "casa perro"), ("a", "casa gato"), (None, "casa"), (None, "casa")], "path string, text string")
    assert not tallies.own_paths(docs)
    assert {r.lemma: (r.frequency, r.docs) for r in co.document_nodes(docs).collect()}["casa"] == (4, 2)
