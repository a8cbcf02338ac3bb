"""Layers, graph algorithms and exports on small cases with known results."""

import heapq
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import concepts as co
from corpusgraph.operators import documents as do
from corpusgraph.operators import export as ex
from corpusgraph.operators import centrality, clustering, gaps, graph, lookup
from corpusgraph.sources import inventory as inv
from corpusgraph.sources import parsers as pr
from corpusgraph.streaming import ingest

# fixed values: Zachary's karate club (1977), the later neighbours of each member
KARATE = {0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31], 1: [2, 3, 7, 13, 17, 19, 21, 30], 2: [3, 7, 8, 9, 13, 27, 28, 32], 3: [7, 12, 13], 4: [6, 10], 5: [6, 10, 16], 6: [16], 8: [30, 32, 33], 9: [33], 13: [33], 14: [32, 33], 15: [32, 33], 18: [32, 33], 19: [33], 20: [32, 33], 22: [32, 33], 23: [25, 27, 29, 32, 33], 24: [25, 27, 31], 25: [31], 26: [29, 33], 27: [33], 28: [31, 33], 29: [32, 33], 30: [32, 33], 31: [32, 33], 32: [33]}
EDGES = [(a, b) for a, bs in KARATE.items() for b in bs]


def frames(spark, edges, n):
    nodes = spark.range(n)
    return nodes, spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a_id long, b_id long, weight double")


def test_karate(spark):
    assert len(EDGES) == 78
    nodes, edges = frames(spark, EDGES, 34)
    labels = clustering.communities(nodes, edges)
    assert labels.select("community").distinct().count() == 4
    q = graph.modularity(edges.toDF("a", "b", "weight"), labels.toDF("node", "community")).first().modularity
    assert 0.41 < q < 0.43
    b = {r.id: r.betweenness for r in centrality.betweenness(nodes, edges).collect()}
    assert abs(b[0] - 231.07) < 0.5 and abs(b[33] - 160.55) < 0.5


def test_small_graphs(spark):
    b = {r.id: r.betweenness for r in centrality.betweenness(*frames(spark, [(0, 1), (1, 2), (2, 3), (3, 4)], 5)).collect()}
    assert [b[i] for i in range(5)] == [0, 3, 4, 3, 0]
    b = {r.id: r.betweenness for r in centrality.betweenness(*frames(spark, [(0, i) for i in range(1, 6)], 6)).collect()}
    assert b[0] == 10 and b[1] == 0
    for k in (2, 3):
        edges = [(3 * c + x, 3 * c + y, 1.0) for c in range(k) for x, y in ((0, 1), (1, 2), (0, 2))]
        found = clustering.communities(spark.range(3 * k + 1), spark.createDataFrame(edges, "a_id long, b_id long, weight double"))
        df = spark.createDataFrame(edges, "a long, b long, weight double")
        assert graph.modularity(df, found.toDF("node", "community")).first().modularity == pytest.approx(1 - 1 / k)
        assert sorted((r.id, r.community) for r in found.collect()) == [(i, i // 3) for i in range(3 * k + 1)]
    parts = {r.id: r.component for r in graph.component_table(*frames(spark, [(0, 1), (2, 3)], 5)).collect()}
    assert parts == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert centrality.pivots(2000) == centrality.pivots(2000) and len(centrality.pivots(2000)) == 400
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {r.node: r.hops for r in graph.hops(e, "a").collect()} == {"a": 0, "b": 1, "c": 2}


def dijkstra(edges, start, end):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, 1 / max(0.01, w)))
        near.setdefault(b, []).append((a, 1 / max(0.01, w)))
    best, heap = {}, [(0.0, [start])]
    while heap:
        cost, path = heapq.heappop(heap)
        if path[-1] in best:
            continue
        best[path[-1]] = path, cost
        for b, c in near.get(path[-1], []):
            heapq.heappush(heap, (cost + c, [*path, b]))
    return best.get(end, (None, None))


def test_routes(spark):
    edges = [("a", "b", 10.0), ("b", "c", 10.0), ("c", "d", 10.0), ("a", "d", 1.0)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    asked = spark.createDataFrame([("a", "d"), ("a", "z"), ("a", "a")], "start string, end string")
    found = {r.end: r.path for r in graph.routes(df, asked).collect()}
    assert found == {"d": ["a", "b", "c", "d"], "z": None, "a": ["a"]}
    shown = spark.createDataFrame([("a",), ("c",), ("d",)], "node string")
    assert {r.end: r.path for r in graph.routes(df, asked, shown).collect()}["d"] == ["a", "d"]
    plan = graph.reading_plans(spark.createDataFrame([("x", "z", ["x", "y", "z"])], "start string, end string, path array<string>"), spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "node string, document string"))
    assert [tuple(r)[3:] for r in plan.orderBy("place").collect()] == [("x", "1", False, False), ("y", None, True, False), ("z", None, False, True)]


def test_routes_equal_dijkstra(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.integers(1, 9, 60)) if a != b]
    asked = [(0, k) for k in range(1, 30)] + [(5, 7)]
    found = graph.routes(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame(asked, "start long, end long")).collect()
    assert len(found) == len(asked)
    for r in found:
        path, cost = dijkstra(edges, r.start, r.end)
        assert r.path == path and (cost is None or r.cost == pytest.approx(cost))


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    links = [(int(i), int(i) + 1) for i in range(40)] + [(100, int(k)) for k in range(101, 130)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (50, 2))]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k in linked}


def test_window_and_weights(spark):
    tokens = [("alfa", 0), ("beta", 0), ("gamma", 0), ("delta", 0), ("epsilon", 1)]
    df = spark.createDataFrame([("d", [dict(lemma=a, form=a, sentence=s) for a, s in tokens])], "path string, tokens array<struct<lemma:string,form:string,sentence:int>>")
    e = {(r.a, r.b): r.tenths for r in co.concept_edges(co.pair_rows(df)).collect()}
    assert e[("alfa", "beta")] == 10 and e[("alfa", "delta")] == 10 and ("alfa", "epsilon") not in e and e[("delta", "epsilon")] == 4


def test_inventory(spark):
    old = spark.createDataFrame([("a", 1, 1000), ("b", 1, 1000), ("c", 1, 1000)], "path string, size long, modified_ms long")
    new = spark.createDataFrame([("a", 1, 2499), ("b", 2, 1000), ("d", 5, None)], "path string, size long, modified_ms long")
    assert {r.path: (r.change, r.reason) for r in inv.difference(new, old).collect()} == {"a": ("same", None), "b": ("candidate", "size"), "c": ("deleted", None), "d": ("new", None)}


def test_links(spark):
    paths = spark.createDataFrame([("notes/a.md",), ("notes/b.md",), ("other/c.txt",), ("x/dup.md",), ("y/dup.md",)], "path string")
    links = spark.createDataFrame([("notes/a.md", t) for t in ("b", "../other/c.txt", "other/c.txt", "C", "dup", "none", "#x", "B.md")], "from_path string, target string")
    got = {r.target: (r.resolved, r.reason) for r in do.resolve_links(links, paths).collect()}
    assert got == {"b": ("notes/b.md", "path"), "../other/c.txt": ("other/c.txt", "path"), "other/c.txt": ("other/c.txt", "path"), "C": ("other/c.txt", "name"), "dup": (None, "ambiguous"), "none": (None, "no target"), "#x": (None, "empty"), "B.md": ("notes/b.md", "path")}


def test_versions(spark):
    paths = spark.createDataFrame([(f"d/{n}.md",) for n in ("essay v1", "essay v2", "essay-v3", "plan draft", "plan final", "plain", "essay_v9")], "path string")
    assert {(r.a, r.b) for r in do.version_chains(paths).collect()} == {("d/essay v1.md", "d/essay v2.md"), ("d/essay v2.md", "d/essay-v3.md"), ("d/plan draft.md", "d/plan final.md")}


def test_references(spark):
    text = "Véase 10.1234/AbC.9). También García et al., 2019 y (Pérez y Gómez, 2020)."
    keys = spark.createDataFrame([(text,)], "t string").select(do.bibliographic_keys(F.col("t")).alias("k")).first().k
    assert set(keys) == {"doi:10.1234/abc.9", "cita:garcía:2019", "cita:pérez:2020"}


def test_affinity(spark):
    docs = {"a": {"x": 5, "y": 3, "all": 9}, "b": {"x": 4, "y": 4, "all": 9}, "c": {"z": 5, "all": 9}, "d": {"q": 2, "all": 1}}
    terms = spark.createDataFrame([(p, k, n) for p, t in docs.items() for k, n in t.items()], "path string, lemma string, n long")
    got = do.affinity(terms, 4).collect()
    assert [(r.a, r.b) for r in got] == [("a", "b")] and got[0].cosine > 0.9


def test_affinity_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(do, "BLOCK", 9)
    monkeypatch.setattr(do, "CHUNK", 4)
    rng = np.random.default_rng(5)
    counts = {f"p{d:02}": {f"t{t}": int(rng.integers(1, 9)) for t in set((rng.zipf(1.4, 25) % 60).tolist())} for d in range(40)}
    counts["p40"] = counts["p39"]
    terms = spark.createDataFrame([(p, t, n) for p, of in counts.items() for t, n in of.items()] + [(None, "t1", 3)], "path string, lemma string, n long")
    df = {}
    for of in [*counts.values(), {"t1": 3}]:
        for t in of:
            df[t] = df.get(t, 0) + 1
    vectors = {}
    for p, of in counts.items():
        w = {t: (1 + np.log(n)) * np.log(42 / df[t]) for t, n in of.items() if df[t] <= 21}
        length = np.sqrt(sum(x * x for x in w.values()))
        vectors[p] = {t: x / length for t, x in w.items()}
    want = {(a, b): sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items()) for a in vectors for b in vectors if a < b}
    pairs = do.affinity(terms, 42, max_pairs=None)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()  # no candidates are shuffled
    got = {(r.a, r.b): r.cosine for r in pairs.collect()}
    assert got == pytest.approx({k: x for k, x in want.items() if x >= 0.12}) and len(got) > 20


def test_parsers(spark):
    rtf = r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}Coraz\'f3n\par \u241?o fin}"
    assert pr.rtf_text(rtf) == "Corazón\nño fin"
    with pytest.raises(ValueError):
        pr.rtf_text("plain")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Uno</w:t></w:r></w:p><w:p><w:r><w:t>Dos</w:t></w:r></w:p></w:body></w:document>')
    files = spark.createDataFrame([("a.docx", "docx", buffer.getvalue()), ("b.docx", "docx", b"no zip"), ("c.rtf", "rtf", rtf.encode()), ("d.png", "png", b"x")], "path string, ext string, content binary")
    assert {r.path: (r.state, r.text) for r in pr.parse_files(files).collect()} == {"a.docx": ("ok", "Uno\n\nDos"), "b.docx": ("error", ""), "c.rtf": ("ok", "Corazón\nño fin"), "d.png": ("metadata only", "")}
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("root/a.md", "x")
        z.writestr("root/sub/b.txt", "yy")
    got = pr.unzip(spark.createDataFrame([("v.zip", box.getvalue()), ("w.zip", b"no zip"), ("n.zip", None)], "path string, content binary")).collect()
    assert {(r.zip_path, r.size) for r in got if r.error is None} == {("a.md", 1), ("sub/b.txt", 2)}
    assert {r.path for r in got if r.error} == {"w.zip", "n.zip"}
    raw = spark.createDataFrame([(b"\xef\xbb\xbfa",), ("ñ".encode("cp1252"),), ("é".encode(),), (b"\xff\xfea\x00",)], "c binary")
    assert [tuple(r.x) for r in raw.select(pr.decode_bytes("c").alias("x")).collect()] == [("a", "utf-8"), ("ñ", "windows-1252"), ("é", "utf-8"), ("a", "utf-16le")]


def test_csv_and_json(spark):
    df = spark.createDataFrame([('folio;"edad ""x"""; fecha\n1;2;3', '{"a": [{"b": 1}, {"b": 2}], "c": null}')], "c string, j string")
    r = df.select(pr.csv_headers("c").alias("h"), pr.json_key_counts("j").alias("k"), pr.csv_separator(F.col("c")).alias("s")).first()
    assert r.h == ["folio", 'edad "x"', "fecha"] and r.k == {"a": 1, "b": 2, "c": 1} and r.s == ";"


def test_gaps_and_questions(spark):
    assert gaps.seed("a") == abs(np.int32(np.uint32(0xE40C292C)))
    assert gaps.listing(["a", "b", "c"], 2) == "a, b" and gaps.listing([]) == "-" and [len(t) for t in gaps.TEMPLATES.values()] == [4, 3, 3]
    gap = dict(ca=1, cb=2, central_a="x", central_b="y", terms_a=["x", "p"], terms_b=["y"], docs_a=["f/one.txt"], docs_b=[], distance=2, edges=1, weight=0.25)
    key = next(f"x{i}" for i in range(99) if gaps.seed(f"e:1:2:x{i}y") % 4 == 1)
    k, text = gaps.question("structural", gap | {"central_a": key})
    assert k == 1 and key in text and "2" in text and gaps.question("structural", gap | {"central_a": key}) == (k, text)
    assert gaps.question("structural", gap | {"central_a": key, "distance": None})[0] == 3
    k, text = gaps.question("isolated", dict(path="d/n.md", terms=3, words=9, affine=["q/z.txt"]))
    assert k == gaps.seed("a:d/n.md") % 3 and "z" in text and ".txt" not in text
    bridge = dict(lemma="l", form="L", community_a=0, community_b=4, near_a=["a", "b", "c"], near_b=["d"], docs_a=["x.md"], docs_b=None)
    own = {"bridge": ("{form}: {a}",)}
    assert gaps.question("bridge", bridge)[0] == gaps.seed("p:l04") % 3 and gaps.question("bridge", bridge, own) == (0, "L: a, b")
    docs = spark.createDataFrame([("a", 10), ("b", 30), ("c", 20), ("d", 0)], "path string, terms long")
    linked = spark.createDataFrame([("b",)], "path string")
    assert [r.path for r in gaps.isolated(docs, linked).collect()] == ["c"]


def test_audit():
    assert ex.audit({"tipo": "tema", "terminos": ["corazón"], "documentos": 3}) == []
    assert ex.audit({"texto": "x"}) and ex.audit({"tipo": "a\nb"}) and ex.audit({"tipo": "Fin. Otra frase"}) and ex.audit({"terminos": ["x" * 121]}) and ex.audit({"terminos": ["a" * 100] * 50})


def test_lookup_and_exports(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("c", "d", 1.0)], "a string, b string, weight double")
    assert [r.dst for r in lookup.leaves_of(e, "a").collect()] == ["b"]
    glance = spark.createDataFrame([("documents", 3)], "name string, value long")
    topics = spark.createDataFrame([(1, "t", ["a/b c.md", "x (1).txt"])], "rank int, text string, documents array<string>")
    rows = ex.report_lines("Corpus", glance, {"Topics": topics, "Gaps": topics.where("false")}).orderBy("section", "rank", "part").collect()
    text = "\n".join(r.line for r in rows)
    assert text == "# Corpus\n\n- documents: 3\n\n## Topics\n\n1. t\n   - [b c](a/b%20c.md)\n   - [x (1)](x%20%281%29.txt)\n\n## Gaps\n\nNone."

    nodes = spark.createDataFrame([(0, "a", "A;b", 3, 2, 1, 2, 1.5, 0.25)], "id long, lemma string, form string, frequency long, docs long, community long, degree long, strength double, betweenness double")
    assert ex.csv_lines(nodes).first().line == '0,a,"A;b",3,2,1,2,1.50,0.250000'
    assert json.loads(ex.json_lines(nodes).first().line)["betweenness"] == 0.25


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    for k, rows in enumerate([[("p1", "hospital renal"), ("p2", "corazón renal")], [("p1", "hospital urbano"), ("p2", "corazón renal")]]):
        spark.createDataFrame(rows, "path string, text string").coalesce(1).write.mode("append").json(str(src))
        q = ingest.index_stream(spark.readStream.schema("path string, text string").json(str(src)), str(tmp_path / "out"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
        counts = {r.lemma: r.doc_count for r in spark.read.parquet(str(tmp_path / "out" / f"vocabulary-{k}")).collect()}
        assert counts == ({"hospital": 1, "renal": 2, "corazon": 1} if k == 0 else {"hospital": 1, "renal": 1, "urbano": 1, "corazon": 1})


def test_missing_bridge(spark):
    nodes = spark.createDataFrame([(0, "bridge", 9.0, 0), (1, "a1", 1.0, 1), (2, "a2", 0.0, 1), (3, "b1", 1.0, 2), (4, "b2", 0.0, 2)], "id long, lemma string, betweenness double, community long")
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (3, 4)], "a_id long, b_id long")
    apart = [("bridge", "x"), ("a1", "x"), ("a2", "x"), ("bridge", "y"), ("b1", "y"), ("b2", "y")]
    got = gaps.missing_bridges(nodes, edges, spark.createDataFrame(apart, "lemma string, path string")).collect()
    assert [(r.id, r.community_a, r.community_b, r.docs_a, r.docs_b, r.score) for r in got] == [(0, 1, 2, 1, 1, 18.0)]
    joined = apart + [("b1", "x")]
    assert gaps.missing_bridges(nodes, edges, spark.createDataFrame(joined, "lemma string, path string")).count() == 0


def test_communities_of_a_million_links(spark):
    """Planted communities of 500 nodes are found again; links are derived by Spark and no step holds the graph."""
    n, size = 20_000, 500
    i = F.col("id")
    a = F.pmod(F.xxhash64(i, F.lit(1)), F.lit(n))
    inner = F.pmod(F.xxhash64(i, F.lit(2)), F.lit(size)) + F.floor(a / size) * size
    b = F.when(i % 10 == 0, F.pmod(F.xxhash64(i, F.lit(3)), F.lit(n))).otherwise(inner)
    edges = spark.range(1_000_000).select(a.alias("a_id"), b.alias("b_id"), F.lit(1.0).alias("weight"))
    found = clustering.communities(spark.range(n), edges)
    mixed = found.groupBy("community").agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("id") / size)).alias("planted")).collect()
    assert len(mixed) == n // size and all(r.n == size and r.planted == 1 for r in mixed)


def test_missing_bridges_against_brute_force(spark):
    rng = np.random.default_rng(3)
    nodes = [(i, f"w{i}", float(rng.integers(1, 9)), i % 4) for i in range(16)]
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 16, (60, 2)) if a < b})
    held = sorted({(f"w{rng.integers(0, 18)}", f"p{rng.integers(0, 60)}") for _ in range(130)})
    near = {i: [b if a == i else a for a, b in edges if i in (a, b)] for i in range(16)}
    of = {p: {x for x, q in held if q == p} for _, p in held}
    want = set()
    for i, lemma, between, _ in nodes:
        count = {c: sum(j % 4 == c for j in near[i]) for c in range(4)}
        sides = sorted((c for c in count if count[c]), key=lambda c: (-count[c], c))[:2]
        own = [s for s in of.values() if lemma in s]
        if len(near[i]) < 2 or len(sides) < 2 or len(own) < 2:
            continue
        met = [[any(f"w{j}" in s for j in near[i] if j % 4 == c) for c in sides] for s in own]
        if any(map(all, met)) or not any(m[0] for m in met) or not any(m[1] for m in met):
            continue
        want.add((i, sides[0], sides[1], sum(m[0] for m in met), sum(m[1] for m in met), between * min(count[c] for c in sides)))
    tables = spark.createDataFrame(nodes, "id long, lemma string, betweenness double, community long"), spark.createDataFrame(edges, "a_id long, b_id long"), spark.createDataFrame(held, "lemma string, path string")
    got = gaps.missing_bridges(*tables, limit=None)
    assert {(r.id, r.community_a, r.community_b, r.docs_a, r.docs_b, r.score) for r in got.collect()} == want and want
