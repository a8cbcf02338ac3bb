"""Queries read whole texts, all short items and all hops."""

from corpusgraph.operators import lookup
from corpusgraph.plans import graph_queries, registry


def test_notes_are_read_whole(spark, tmp_path):
    text = "word " * 100 + "[[late|x]] and [y](deep/file.md) ``` code ``` **end**"
    spark.createDataFrame([(7, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    links = registry.QUERIES["note_links"](spark, str(tmp_path)).first()
    assert links.wiki == "doc-8 late" and links.plain == "../en/doc-9.txt deep/file.md"
    clean = registry.QUERIES["markdown_text"](spark, str(tmp_path)).first().clean
    assert clean.count("word") == 100 and "late" in clean and "end" in clean and "code ```" not in clean and "**" not in clean


def test_short_items_are_all_probed(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MAX_PROBES", 1, raising=False)
    items = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "ta ga")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alphabet beta gamma")], "doc_id long, text string")
    assert {r.item_id: r.documents for r in lookup.literal_leaks(items, docs).collect()} == {1: 1, 2: 1, 3: 1}


def test_hop_distance_goes_to_the_end(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(12)], "id long, lemma string")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(11)], "a_id long, b_id long, weight double")
    monkeypatch.setattr(graph_queries, "_cut", lambda spark, sf: (nodes, edges))
    assert {r.lemma: r.hops for r in graph_queries.hop_distance(spark, "").collect()} == {f"n{i}": i for i in range(12)}
