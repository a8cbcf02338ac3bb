"""Past states, the graph kept by a stream, places of tokens, the short hash."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text as tx
from corpusgraph.operators import concepts as co
from corpusgraph.operators import history
from corpusgraph.sources import inventory as inv
from corpusgraph.streaming import graph_stream

WORDS = "hospital renal corazón territorio lectura grafo concepto paciente estudio ciudad".split()


def text(seed):
    r = random.Random(seed)
    return ". ".join(" ".join(r.choice(WORDS) for _ in range(r.randint(2, 6))) for _ in range(r.randint(1, 4)))


def fresh(spark, docs):
    """Nodes and edges of a build from scratch."""
    df = spark.createDataFrame(sorted(docs.items()) or [("none", "")], "path string, text string")
    analysis = co.analyzed(df)
    nodes = {(r.lemma, r.frequency, r.docs) for r in co.concept_nodes(co.exploded(analysis)).collect()}
    return nodes, {(r.a, r.b, r.tenths, r.docs) for r in co.concept_edges(co.pair_rows(analysis)).collect()}


CHANGES = [("a", 1, text(1)), ("b", 1, text(2)), ("a", 3, text(3)), ("b", 4, None), ("c", 4, text(4)), ("a", 5, text(3)), ("b", 6, text(5)), (None, 1, "x"), ("d", None, "x"), ("e", 2, None), ("a", 7, "")]


def test_a_past_state_equals_a_fresh_build(spark):
    changes = spark.createDataFrame(CHANGES, "path string, at int, text string")
    spans = history.versions(changes)
    assert {(r.path, r.valid_from, r.valid_to) for r in spans.collect()} == {("a", 1, 3), ("a", 3, 7), ("a", 7, None), ("b", 1, 4), ("b", 6, None), ("c", 4, None)}
    analysis = history.analysed(spans)
    nodes, edges = history.node_history(analysis).cache(), history.edge_history(analysis).cache()
    for when in (0, 1, 4, 8):
        docs = {}
        for path, at, body in sorted((c for c in CHANGES if None not in c[:2]), key=lambda c: c[1]):
            if at <= when:
                docs[path] = body
        got = {tuple(r) for r in history.at(nodes, when).select("lemma", "frequency", "docs").collect()}, {tuple(r) for r in history.at(edges, when).select("a", "b", "tenths", "docs").collect()}
        assert got == fresh(spark, {p: t for p, t in docs.items() if t is not None})
    each = history.at_each(edges, [1, 4]).collect()
    assert {tuple(r)[1:] for r in each if r.date == 4} == {tuple(r) for r in history.at(edges, 4).collect()}
    new = history.moved(history.at(nodes, 1), history.with_degrees(history.at(nodes, 4), history.at(edges, 4))).collect()
    assert all(r.degree >= 0 for r in new) and {r.lemma for r in new if r.is_new}.isdisjoint({r.lemma for r in history.at(nodes, 1).collect()})
    assert history.node_history(history.analysed(history.versions(changes.where("false")))).count() == 0


@pytest.mark.parametrize("order", [1, 2])
def test_a_stream_of_differences_equals_a_full_build(spark, tmp_path, order):
    rows = [(p, t, at) for p, at, t in CHANGES if p is not None and at is not None]
    batches = [rows[:3], rows[3:6], rows[6:]] if order == 1 else [rows[5:], rows[:2], rows[2:5]]
    folder, check, src = str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "in")
    counts = []
    for batch in [*batches, batches[-1]]:
        spark.createDataFrame(batch, "path string, text string, at long").coalesce(1).write.mode("append").json(src)
        q = graph_stream.start(spark.readStream.schema("path string, text string, at long").json(src), folder, check)
        q.processAllAvailable()
        q.stop()
        counts.append(spark.read.schema(graph_stream.DIFFERENCE).parquet(folder).count())
    assert counts[-1] == counts[-2]  # a repeated batch changes nothing and writes nothing
    written = spark.read.parquet(folder)
    last = {}
    for p, t, at in sorted(rows, key=lambda r: r[2]):
        last[p] = t
    want = fresh(spark, {p: t for p, t in last.items() if t is not None})
    for table in (written, graph_stream.compacted(written)):
        nodes, edges = graph_stream.graph(table)
        assert ({tuple(r) for r in nodes.collect()}, {tuple(r) for r in edges.collect()}) == want


def test_every_token_is_found_in_its_place(spark):
    texts = ["", "  ¡Hola! Dr. Núñez vio a la paciente-modelo: 3.5 mg; l'estudio… Año 2024.\n\nOtra línea", None, "x" * 50 + " ñandú-es", "Mixed 日本語 text. And e.g. more of it!"]
    df = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, text string")
    found = {}
    for r in tx.token_places(df).orderBy("path", "pos").collect():
        found.setdefault(r.path, []).append((r.lemma, r.form))
        assert texts[int(r.path[1:])][r.begin : r.finish] == r.form
    told = {}
    for r in co.token_rows(df).orderBy("path", "pos").collect():
        told.setdefault(r.path, []).append((r.lemma, r.form))
    assert found == told and len(found) == 3


def test_the_short_hash(spark):
    def slow(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"fnv64:{h:016x}:{len(data):x}"

    values = [b"", b"a", b"foobar", bytes(range(256)) * 3, "ñ日".encode()]
    got = spark.createDataFrame([(v,) for v in values], "c binary").select(inv.content_hash_fnv(F.col("c")).alias("h"), "c").collect()
    assert all(r.h == slow(bytes(r.c)) for r in got) and slow(b"foobar").startswith("fnv64:85944171f73967e8")
