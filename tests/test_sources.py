"""PDF files, folders and archives; exports as single files."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import documents as do
from corpusgraph.operators import export as ex
from corpusgraph.sources import folder, pdf, sinks

LINES = ["Corazón y riñón: a (short) line \\ with marks", "The second line of this page holds more words than the first one does."]


def write(objects, trailer="/Root 1 0 R", damage=False, packed=()):
    """A PDF of numbered bodies; those in packed lie in an object stream behind a cross-reference stream with a PNG predictor."""
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n, body in objects.items():
        if n not in packed:
            at[n] = len(out)
            out += b"%d 0 obj\n%b\nendobj\n" % (n, body)
    if not packed:
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (max(at) + 1)
        out += b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(1, max(at) + 1))
        out += b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF" % (max(at) + 1, trailer.encode(), 7 if damage else start)
        return bytes(out)
    inner, head, top = b"", b"", max(objects)
    for n in packed:
        head += b"%d %d " % (n, len(inner))
        inner += objects[n] + b" "
    at[top + 1] = len(out)
    body = zlib.compress(head + inner)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n%b\nendstream\nendobj\n" % (top + 1, len(packed), len(head), len(body), body)
    start = len(out)
    rows = [(0, 0, 0)] + [(2, top + 1, packed.index(n)) if n in packed else (1, at[n], 0) if n in at else (0, 0, 0) for n in range(1, top + 2)] + [(1, start, 0)]
    raw = [bytes([k]) + a.to_bytes(3, "big") + bytes([b]) for k, a, b in rows]
    table = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(row, above)) for row, above in zip(raw, [bytes(5), *raw]))
    table = zlib.compress(table)
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 3 1] %s /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> /Length %d >> stream\n%b\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (top + 2, top + 3, trailer.encode(), len(table), table, start)
    return bytes(out)


def stream(data, more="", packed=True):
    body = zlib.compress(data) if packed else data
    return b"<< %s %s /Length %d >> stream\r\n%b\r\nendstream" % (more.encode(), b"/Filter /FlateDecode" if packed else b"", len(body), body)


def literal(text):
    return b"(" + text.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def simple(contents, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", extra=None):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font}
    kids = []
    for i, content in enumerate(contents):
        objects[10 + 2 * i], objects[11 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i), content
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<< /Type /Pages /Kids [%b] /Count %d /Resources << /Font << /F1 3 0 R >> /XObject << /X1 4 0 R >> >> >>" % (b" ".join(kids), len(kids))
    return objects | (extra or {})


PAGE = b"BT /F1 12 Tf 72 700 Td " + literal(LINES[0]) + b" Tj 0 -14 Td " + literal(LINES[1]) + b" Tj ET"


@pytest.mark.parametrize("how", [{}, {"damage": True}, {"packed": (1, 2, 3)}, {"trailer": "/Root 9 0 R"}])
def test_cross_references(how):
    assert pdf.read(write(simple([stream(PAGE)]), **({"trailer": "/Root 1 0 R"} | how))) == ("ok", "\n".join(LINES), None)


def test_operators_and_spaces():
    content = b"q 1 0 0 1 5 5 cm BT /F1 10 Tf 14 TL 1 0 0 1 10 600 Tm [(Wo) -20 (rd) -600 (next)] TJ T* (below) Tj (and on) ' ET Q\nBI /W 1 /H 1 ID x(EI) y\nEI\nBT /F1 10 Tf 10 400 Td (after) Tj 100 0 Td (far) Tj ET /X1 Do"
    form = stream(b"BT /F1 8 Tf 1 2 Td <466f726d> Tj ET", "/Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 50]")
    document = pdf.Document(write(simple([stream(content, packed=False)], extra={4: form})))
    assert [pdf.page_text(document, *page) for page in document.pages()] == ["Word next\nbelow\nand on\nafter far\nForm"]


def test_fonts():
    named = b"<< /Type /Font /Subtype /Type1 /Encoding << /Type /Encoding /Differences [1 /eacute /uni0416 /space /fi 10 /A /nothing.here] >> >>"
    document = pdf.Document(write(simple([stream(b"BT /F1 9 Tf <010203040A0B> Tj ET")], named)))
    assert [pdf.page_text(document, *p) for p in document.pages()] == ["éЖ fiA"]
    table = stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0005> <00480069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<65E5> <D83DDE00>] endbfrange")
    wide = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R /DescendantFonts [<< /DW 500 /W [5 [900] 16 18 400] >>] >>"
    document = pdf.Document(write(simple([stream(b"BT /F1 9 Tf <0005001000110012> Tj <00200021FFFF> Tj ET")], wide, {5: table})))
    assert [pdf.page_text(document, *p) for p in document.pages()] == ["Hiabc日\U0001f600"]


def test_states(spark):
    bad = b"<< /Filter /DCTDecode /Length 3 >> stream\nabc\nendstream"
    files = {
        "two.pdf": write(simple([stream(PAGE), bad])),
        "scan.pdf": write(simple([stream(b"q Q")])),
        "locked.pdf": write(simple([stream(PAGE)]), "/Root 1 0 R /Encrypt 3 0 R"),
        "none.pdf": b"nothing",
        "null.pdf": None,
        "loop.pdf": write({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R 2 0 R] >>"}),
    }
    assert pdf.read(files["two.pdf"])[0::2] == ("ok", "1 of 2 pages could not be read") and pdf.read(files["scan.pdf"])[0] == "no text"
    rows = pdf.pages(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()
    got = {(r.path, r.page): (r.text, r.error) for r in rows}
    assert got["two.pdf", 1] == ("\n".join(LINES), None) and "DCTDecode" in got["two.pdf", 2][1] and got["scan.pdf", 1] == ("", None)
    assert "password" in got["locked.pdf", None][1] and got["none.pdf", None][1] and got["null.pdf", None][1] and got["loop.pdf", None] == ("", "no pages")
    for n in range(0, len(files["two.pdf"]), 37):  # a file cut anywhere is read or refused, never endless
        try:
            pdf.read(files["two.pdf"][:n])
        except pdf.PdfError:
            pass


def test_inflating_is_bounded(monkeypatch):
    monkeypatch.setattr(pdf, "MAX_STREAM", 1000)
    document = pdf.Document(write(simple([stream(b" " * 100_000)])))
    with pytest.raises(pdf.PdfError, match="bound"):
        [pdf.page_text(document, *p) for p in document.pages()]


def archive(entries):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return box.getvalue()


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "vault"
    files = {
        "note.md": b"# Title\n\nSee [[other]], [the page](sub/my%20page.html).\nsub/deep/list.txt\nGraphs grow.",
        "sub/my page.html": b"<p>Words of a page</p><a href='../note.md'>x</a>",
        "sub/deep/list.txt": b"plain text",
        "sub/.Report.PDF.icloud": b"bplist",
        "other.md": b"",
        ".git/config": b"x",
        "node_modules/a/b.txt": b"x",
        ".hidden": b"x",
        ".kept.md": b"hidden note",
        "paper.pdf": write(simple([stream(PAGE)])),
        "bundle.zip": archive({"box/one.txt": b"uno dos", "box/in/two.md": b"[[one]]", "box/__MACOSX/x": b"", "box/Thumbs.db": b"", "box/bomb.txt": b"0" * 300_000}),
        "bad.zip": b"no archive",
        "/".join(["d"] * 13) + "/low.txt": b"too deep",
        "/".join(["d"] * 12) + "/edge.txt": b"deep enough",
    }
    for name, data in files.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(top)


def test_folder_scan(spark, root):
    found = {r.path: r for r in folder.scan(spark, root).collect()}
    assert set(found) == {"note.md", "sub/my page.html", "sub/deep/list.txt", "sub/Report.PDF", "other.md", ".kept.md", "paper.pdf", "bundle.zip", "bad.zip", "/".join(["d"] * 12) + "/edge.txt"}
    assert found["sub/Report.PDF"].placeholder and found["sub/Report.PDF"].size == 0 and found["note.md"].content and found["note.md"].modified_ms > 0
    assert folder.scan(spark, root, content=False).where("content IS NOT NULL").count() == 0
    assert {r.path for r in folder.scan(spark, root, depth=1).collect() if "/" in r.path} == {"sub/my page.html", "sub/Report.PDF"}


def test_folder_to_index_in_one_call(spark, root):
    index = {r.path: r for r in folder.index(spark, root).collect()}
    states = {p: r.state for p, r in index.items()}
    assert states["note.md"] == states["paper.pdf"] == states["bundle.zip/one.txt"] == states["bundle.zip/in/two.md"] == "ok"
    assert states["other.md"] == "no text" and states["sub/Report.PDF"] == states["bad.zip"] == "error" and index["bad.zip"].error
    assert index["note.md"].links == ["other", "sub/my page.html", "sub/deep/list.txt"] and index["sub/my page.html"].links == ["../note.md"]
    assert {t.lemma for t in index["paper.pdf"].terms} >= {"corazon", "second"} and "bundle.zip/Thumbs.db" not in index
    df = spark.createDataFrame([(p, list(r.links)) for p, r in index.items()], "path string, links array<string>")
    links = df.select(F.col("path").alias("from_path"), F.explode("links").alias("target"))
    resolved = {(r.from_path, r.target): r.resolved for r in do.resolve_links(links, df.select("path")).collect()}
    assert resolved["note.md", "other"] == "other.md" and resolved["sub/my page.html", "../note.md"] == "note.md" and resolved["bundle.zip/in/two.md", "one"] == "bundle.zip/one.txt"


def test_archives_are_bounded(spark, root):
    archives = spark.createDataFrame([(f"{root}/bundle.zip", "bundle.zip"), (f"{root}/bad.zip", "bad.zip")], "archive string, path string")
    plan = folder.planned(archives)
    assert {r.zip_path for r in plan.collect()} == {"one.txt", "in/two.md", "bomb.txt", None}
    rows = {r.path: r for r in folder.entries(plan, 3, most=100_000).collect()}
    assert rows["bundle.zip/bomb.txt"].content is None and "bound" in rows["bundle.zip/bomb.txt"].error and rows["bundle.zip/bomb.txt"].size == 300_000
    assert rows["bundle.zip/one.txt"].content == b"uno dos" and rows["bad.zip"].error
    assert folder.common_root(["a/b"]) == "" and folder.common_root(["a/b", "a/c/d"]) == "a/" and folder.common_root(["a/b", "c"]) == ""


def test_one_file_from_many_parts(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n")).select("n", F.concat(F.lit("line "), F.col("n").cast("string")).alias("line")).repartition(7)
    path = str(tmp_path / "out.txt")
    sinks.write_lines(rows, path, ["n"], eol="\r\n", mark=True, header="head")
    want = "\ufeffhead\r\n" + "".join(f"line {i}\r\n" for i in range(5000))
    assert open(path, "rb").read() == want.encode() and [p.name for p in tmp_path.iterdir()] == ["out.txt"]
    sinks.write_lines(rows.where("false"), path, ["n"])
    assert open(path, "rb").read() == b""
    bad = rows.select("n", F.when(F.col("n") == 4000, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("line")).alias("line"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_lines(bad, path, ["n"])
    assert open(path, "rb").read() == b"" and [p.name for p in tmp_path.iterdir()] == ["out.txt"]


def test_exports(spark, tmp_path):
    columns = "id long, lemma string, form string, frequency long, docs long, community long, degree long, strength double, betweenness double"
    nodes = spark.createDataFrame([(1, "b", 'B "x"', 2, 1, 0, 1, 0.5, 0.1234567), (0, "a", "A;b", 3, 2, 1, 2, 1.5, 0.25)], columns)
    ex.write_csv(nodes, str(tmp_path / "c.csv"))
    assert open(tmp_path / "c.csv", "rb").read() == ("\ufeff" + ex.CSV_HEADER + '\r\n0,a,"A;b",3,2,1,2,1.50,0.250000\r\n1,b,"B ""x""",2,1,0,1,0.50,0.123457\r\n').encode()
    edges = spark.createDataFrame([(0, 1, 2.0)], "a long, b long, weight double")
    ex.write_json({"nodes": (nodes.select("id", "lemma"), ["id"]), "edges": (edges, ["a", "b"]), "gaps": (edges.where("false"), ["a"])}, str(tmp_path / "g.json"))
    assert json.load(open(tmp_path / "g.json")) == {"nodes": [{"id": 0, "lemma": "a"}, {"id": 1, "lemma": "b"}], "edges": [{"a": 0, "b": 1, "weight": 2.0}], "gaps": []}
    vault = tmp_path / "vault"
    (vault / "sub").mkdir(parents=True)
    (vault / "sub" / "my note.md").write_text("Words of a note.")
    topics = spark.createDataFrame([(1, "first topic", ["sub/my note.md"])], "rank int, text string, documents array<string>")
    ex.write_report(str(vault / "report.md"), "Corpus", spark.createDataFrame([("documents", 1)], "name string, value long"), {"Topics": topics})
    index = folder.index(spark, str(vault))
    links = index.select(F.col("path").alias("from_path"), F.explode("links").alias("target"))
    assert [(r.from_path, r.resolved) for r in do.resolve_links(links, index.select("path")).collect()] == [("report.md", "sub/my note.md")]
