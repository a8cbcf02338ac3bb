"""Files of every kind become index rows; short items, numeric entities and batches in order."""

import io
import zipfile

from pyspark.sql import functions as F

from corpusgraph.operators import lookup, views
from corpusgraph.sources import assembly
from corpusgraph.sources import parsers as pr
from corpusgraph.streaming import ingest

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(text):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return box.getvalue()


FILES = {
    "notes/first note.md": b"# Graph theory\n\n[[other|x]] graphs and graphs. Networks grow.",
    "plain.txt": "Ciudades y caf\u00e9s. Las ciudades crecen.".encode("cp1252"),
    "empty.txt": b"  \n ",
    "none.txt": None,
    "page.html": b"<html><head><title>Page</title></head><body><p>caf&#233; &#x41;&amp;B</p><script>x</script></body></html>",
    "table.csv": b"patient_id;blood.pressure;date\n1;2;3",
    "bad.json": b"{",
    "flat.json": b"[1, 2]",
    "keys.json": b'{"visit_date": 1, "items": [{"visit_date": 2}, {"visit_date": 3}]}',
    "letter.rtf": b"{\\rtf1\\ansi Coraz\\'f3n}",
    "report.docx": docx("Los territorios crecen"),
    "broken.docx": b"no zip",
    "scan.pdf": b"%PDF",
    "photo.png": b"\x89PNG",
    "cloud.pdf": b"",
    "noextension": b"bytes",
}


def test_every_file_becomes_a_row(spark):
    rows = [(p, 100 << 20 if p == "plain.txt.big" else len(c or b""), c, p == "cloud.pdf") for p, c in FILES.items()] + [("huge.txt", 100 << 20, b"x", None)]
    files = spark.createDataFrame(rows, "path string, size long, content binary, placeholder boolean")
    parsed = {r.path: r for r in assembly.parsed(files).collect()}
    assert set(parsed) == {*FILES, "huge.txt"}
    state = {p: r.state for p, r in parsed.items()}
    ok = {"notes/first note.md", "plain.txt", "page.html", "table.csv", "keys.json", "letter.rtf", "report.docx"}
    assert {p for p, s in state.items() if s == "ok"} == ok
    assert {p for p, s in state.items() if s == "no text"} == {"empty.txt", "none.txt", "flat.json"}
    assert {p for p, s in state.items() if s == "error"} == {"bad.json", "broken.docx", "cloud.pdf", "huge.txt", "scan.pdf"}
    assert {p for p, s in state.items() if s == "metadata only"} == {"photo.png", "noextension"}
    assert all(r.error for p, r in parsed.items() if state[p] in ("error", "metadata only"))
    assert "caf\u00e9 A&B" in parsed["page.html"].text and "#" not in parsed["notes/first note.md"].text
    assert parsed["table.csv"].text == "patient id \nblood pressure \ndate" and parsed["keys.json"].text == "items visit date visit date visit date"
    assert parsed["letter.rtf"].text == "Coraz\u00f3n" and parsed["plain.txt"].text.startswith("Ciudades y caf\u00e9s")
    assert parsed["cloud.pdf"].hash == assembly.NOT_HERE and parsed["huge.txt"].hash == assembly.ERROR

    index = {r.path: r for r in assembly.assembled(assembly.parsed(files)).collect()}
    note = index["notes/first note.md"]
    assert {t.lemma: t.n for t in note.terms}["graph"] >= 1 and "notes" in note.path_terms and not note.truncated
    assert index["photo.png"].terms == [] and index["photo.png"].path_terms == ["photo"] and index["none.txt"].words == 0
    assert index["report.docx"].words == 3 and index["empty.txt"].tokens == 0
    assert assembly.assembled(assembly.parsed(files.where("false"))).count() == 0


def test_long_texts_are_cut_for_the_index(spark):
    text = "palabra " * 300_000
    files = spark.createDataFrame([("a.txt", len(text), text.encode())], "path string, size long, content binary")
    row = assembly.assembled(assembly.parsed(files)).first()
    assert row.truncated and row.words == -(-assembly.MAX_TEXT // 8)


def test_numeric_entities(spark):
    df = spark.createDataFrame([("&#65;&#x42;&#X43; &#0; &#xD800; &#99999999; &#ab;",), (None,)], "t string")
    assert [r.x for r in df.select(pr.decode_numeric("t").alias("x")).collect()] == ["ABC &#0; &#xD800; &#99999999; &#ab;", None]


def test_short_items_inside_words(spark):
    docs = spark.createDataFrame([(1, "alphabet beta gamma"), (2, "beta  gamma"), (3, "etag"), (4, None), (5, "a b"), (6, "lpha")], "doc_id long, text string")
    items = [(1, "alpha"), (2, "ta ga"), (3, "lpha"), (4, "a"), (5, "zz"), (6, " "), (7, "  "), (8, "beta gamma"), (9, "\u00e9")]
    found = {r.item_id: (r.documents, r.first_doc) for r in lookup.literal_leaks(spark.createDataFrame(items, "item_id long, text string"), docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, t in items:
        hits = [d for d, x in texts.items() if x is not None and t in x]
        assert found[i] == (len(hits), min(hits, default=None)), t


def test_latest_text_of_a_batch_counts(spark):
    index, counts = spark.createDataFrame([], "path string, hash string, lemmas array<string>"), spark.createDataFrame([], "lemma string, doc_count long")
    for order in ((1, 2), (2, 1)):
        batch = spark.createDataFrame([("a", "montes altos", order[0]), ("a", "rios largos", order[1])], "path string, text string, modified_ms long")
        kept, _ = ingest.apply_batch(index, counts, batch)
        assert ("rio" in kept.first().lemmas[0]) == (order[1] == 2)


def test_views_on_small_cases(spark):
    nodes = spark.createDataFrame([(1, "Graph", "graph", None, None, None), (2, None, None, "x/graph.md", "md", 5), (3, None, None, "y/z.txt", "txt", 9)], "id long, form string, lemma string, path string, ext string, modified_ms long")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(views.filtered(nodes)) == [1, 2, 3] and ids(views.filtered(nodes, "md")) == [1, 2]
    assert ids(views.filtered(nodes, since_ms=6)) == [1, 3] and ids(views.filtered(nodes, search="GRAPH")) == [1, 2]
    assert {r.hits for r in views.search_hits(nodes, "graph").collect()} == {2} and views.search_hits(nodes, "").count() == 0
    at = spark.range(1).select(*[views.least_weight(F.lit(v), F.lit(s)).alias(f"w{v}_{i}") for v in (50, 200, 900) for i, s in enumerate((0.2, 0.6, 1.0, 2.0))]).first()
    assert list(at) == [0, 0, 0, 0, 1.5, 0, 0, 0, 3, 2, 1.2, 0]
    before = spark.createDataFrame([("a", "1", 5), ("b", None, 2), ("c", "3", 1)], "path string, hash string, words long")
    after = spark.createDataFrame([("a", "2", 9), ("b", None, 2), ("d", "4", 3)], "path string, hash string, words long")
    assert sorted(map(tuple, views.state_delta(before, after).collect())) == [("a", "modified", 4), ("c", "deleted", -1), ("d", "new", 3)]
    groups = {r.path: (r.folder, r.community) for r in views.folder_groups(spark.createDataFrame([("b/x",), ("a/y",), ("a/z",), ("top",)], "path string")).collect()}
    assert groups == {"a/y": ("a", 0), "a/z": ("a", 0), "b/x": ("b", 1), "top": ("", 2)}
    assert [r.n for r in spark.createDataFrame([("a/b.c.txt",), ("",), (None,)], "p string").select(views.short_name(F.col("p")).alias("n")).collect()] == ["b.c", "un documento", "un documento"]


def test_texts_are_analysed_as_the_expressions_do(spark):
    from corpusgraph.functions import text as tx

    texts = ["Los hospitales grandes. Dr. Pérez corre_y come.\n\n\nCasas y casas, Casas.", "", " \n ", "the of and to in is was on the of and to in is was on the of and running cities"]
    rows = spark.createDataFrame([(f"d/{i}.txt", t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: r for r in assembly.assembled(rows).collect()}
    known = rows.withColumn("language", tx.language(F.col("text"))).withColumn("t", tx.tokens(F.col("text"), F.col("language"))).withColumn("s", tx.sentences(F.col("text")))
    for r in known.collect():
        assert (got[r.path].language, got[r.path].tokens, got[r.path].sentences) == (r.language, len(r.t), len(r.s))
    assert [(t.lemma, t.form, t.n) for t in got["d/0.txt"].terms][0] == ("casa", "Casas", 3)
    assert "ArrowEvalPython" not in assembly.assembled(rows)._jdf.queryExecution().executedPlan().toString()  # terms are stored with the rest
