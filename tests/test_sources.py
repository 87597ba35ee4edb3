"""Parsers: what each format gives, and that nothing makes them raise."""

import json

import pytest

from sheafwork.options import ConvertOptions, Limits
from sheafwork.sources import samples
from sheafwork.sources.html import parse_html
from sheafwork.sources.office import shown_number
from sheafwork.sources.parse import parse_one, register, sniff
from sheafwork.sources.rtf import text_of

O = ConvertOptions()
TEXT = "Hello world line.\nSecond line é.\nThird: x"


def parse(kind, options=O):
    data = samples.build(kind, TEXT)
    return parse_one(data, f"a.{kind}", sniff(data, f"a.{kind}"), options)


def kinds(doc):
    return [b["type"] for b in doc["blocks"]]


def test_docx():
    doc = parse("docx")
    assert doc["title"] == "Sample"
    assert kinds(doc) == ["heading", "paragraph", "paragraph", "paragraph", "list", "table"]
    assert [(i["depth"], i["text"]) for i in doc["blocks"][4]["items"]] == [(0, "a point"), (1, "a second")]
    assert doc["blocks"][5]["header"] == ["Name", "Size"]
    assert json.loads(doc["metadata"])["author"] == "A. Writer"


def test_pptx_reads_shapes_from_the_top():
    doc = parse("pptx")
    assert kinds(doc)[:4] == ["page_break", "heading", "paragraph", "list"]
    assert doc["blocks"][1]["text"] == "First slide" and doc["blocks"][5]["text"] == "Slide 2"


def test_xlsx_shows_cells_as_the_sheet_does():
    doc = parse("xlsx")
    t = doc["blocks"][1]
    assert t["header"] == ["Month", "Sum", "Growth"]
    assert t["rows"] == [["Jan", "$1,234.50", "25%"], ["Feb", "-$890.00", "2024-01-01"]]
    assert doc["blocks"][2]["type"] == "paragraph"
    assert "Scratch" in doc["warnings"][0]
    assert len(parse("xlsx", O.with_(include_hidden_sheets=True))["blocks"]) > len(doc["blocks"])


def test_numbers():
    import datetime as dt

    e = dt.datetime(1899, 12, 30)
    assert [shown_number(*x, e) for x in ((1234567.89, "General"), (0.5, "0.0%"), (3.0, "General"), (-5, '"€"0.00'), (45292.5, "yyyy-mm-dd h:mm"))] == ["1234567.89", "50.0%", "3", "-€5.00", "2024-01-01T12:00:00"]


def test_epub_follows_the_spine():
    doc = parse("epub")
    assert doc["title"] == "A Book"
    assert [b["text"] for b in doc["blocks"] if b["type"] == "heading"] == ["Chapter one", "Two"]


def test_archive_converts_members_deeper():
    doc = parse("zip")
    heads = [(b["level"], b["text"]) for b in doc["blocks"] if b["type"] == "heading"]
    assert (2, "notes.md") in heads and (2, "inner.zip") in heads and not any("MACOSX" in t for _, t in heads)
    assert any(b["type"] == "raw" and b["text"].startswith("### Notes") for b in doc["blocks"])


def test_archive_guards():
    bomb = samples.container({"a.txt": b"0" * 5_000_000})
    assert parse_one(bomb, "a.zip", "zip", O)["error"]["code"] == "limit_exceeded"
    many = samples.container({f"{i}.txt": "text." for i in range(9)})
    assert "first 5" in parse_one(many, "a.zip", "zip", O.with_(limits=Limits(max_archive_members=5)))["warnings"][0]
    deep = b"x"
    for i in range(6):
        deep = samples.container({f"{i}.zip" if i else "t.txt": deep})
    doc = parse_one(deep, "a.zip", "zip", O)
    assert doc["error"] is None and any("nested deeper" in w for w in doc["warnings"])
    sly = samples.container({"../../etc/passwd": "x", "/abs": "y", "ok.txt": "fine."})
    assert [b["text"] for b in parse_one(sly, "a.zip", "zip", O)["blocks"] if b["type"] == "heading"] == ["ok.txt"]


def test_notebook_mail_json():
    assert parse("ipynb")["title"] == "Sample" and kinds(parse("ipynb"))[:3] == ["raw", "code", "code"]
    mail = parse("eml")
    assert mail["title"] == "Sample" and kinds(mail)[0] == "key_values"
    assert "table" in kinds(parse("json")) and parse("jsonl")["warnings"] == ["1 lines are not valid JSON."]


def test_csv_variants():
    bom = b'\xef\xbb\xbfname;note;amount\r\n"a\nb";"say ""hi""";1\r\nshort\r\n'
    t = parse_one(bom, "a.csv", "csv", O)["blocks"][0]
    assert t["rows"][0] == ["a\nb", 'say "hi"', "1"] and t["rows"][1] == ["short", "", ""]
    cut = parse_one(b"a,b\n" + b"1,2\n" * 50, "a.csv", "csv", O.with_(limits=Limits(max_csv_rows=10)))
    assert "first 10" in cut["warnings"][0]
    assert parse_one("name,city\nx,Köln\n".encode("latin-1"), "a.csv", "csv", O)["blocks"][0]["rows"][-1][1] == "Köln"


def test_html():
    doc = parse_html(b"<title>T</title><nav>no</nav><body><p>a <b>bold</b> <a href='u'>link</a><p>next<blockquote>q</blockquote><pre><code class='language-py'>x</code></pre><table><tr><th>h<th>i<tr><td>1<td><table><tr><td>in</table></table><script>alert(1)</script>", "a.html", O)
    assert kinds(doc) == ["paragraph", "paragraph", "quote", "code", "table"]
    assert doc["blocks"][0]["text"] == "a **bold** [link](u)" and doc["blocks"][3]["lang"] == "py"
    assert doc["blocks"][4]["header"] == ["h", "i"] and len(doc["blocks"][4]["rows"]) == 1


def test_rtf():
    data = b"{\\rtf1{\\fonttbl{\\f0 Arial;}}a \\b bold\\b0  \\'e9 \\u8364? {\\*\\gone x}end}"
    assert text_of(data).split() == ["a", "**bold**", "é", "€", "end"]


def test_pages_of_lines(spark):
    """What is made of the lines of pages: running lines go, sizes rank, tables stand where they stood."""
    from pyspark.sql import functions as F

    from sheafwork.operators import layout
    from sheafwork.schema import LAYOUT
    from sheafwork.sources.model import table

    lines = []
    for n in (1, 2, 3):
        texts = [(f"Report {n}", 8.0), ("one two three four".split()[n], 24.0), ("Body text that goes on", 11.0), ("and ends here.", 11.0), (f"- a point of {'xyzw'[n]}", 11.0), ("Known Entry", 11.0), (f"on page {'abc'[n - 1]}.", 11.0), (str(n), 8.0)]
        lines += [{"page": n, "line_no": k, "y": 10.0 * k, "size": size, "bold": False, "text": t} for k, (t, size) in enumerate(texts)]
    grid = table([["1", "2"]], header=["a", "b"], page=2)
    found = {"number": 4, "lines": lines, "tables": [{"page": 2, "y": 25.0, "block": grid}], "outline": [{"page": 3, "title": "known entry", "level": 2}]}
    out = spark.createDataFrame([(found,)], f"layout {LAYOUT}").select(F.inline(F.array(layout.as_blocks(F.col("layout"))))).first()
    kinds = [b["type"] for b in out["blocks"]]
    assert kinds == ["page_break", "heading", "paragraph", "list", "paragraph", "page_break", "heading", "paragraph", "table", "paragraph", "list", "paragraph", "page_break", "heading", "paragraph", "list", "heading", "paragraph", "page_break"]
    assert out["blocks"][2]["text"] == "Body text that goes on and ends here." and out["blocks"][-3]["level"] == 2
    assert out["removed"] == ["report #"] and out["empty"] == 1


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(spark, packed):
    import sheafwork

    lines = [f"Line {i} of the text goes on for a while, übér {chr(0x4E00 + i)}" + ("." if i % 3 == 0 else "") for i in range(100)]
    data = samples.pdf(lines, packed=packed)
    doc = parse_one(data, "a.pdf", "pdf", O)
    assert doc["error"] is None and doc["title"] == "Sample" and json.loads(doc["metadata"])["author"] == "A. Writer" and json.loads(doc["metadata"])["created"] == "2024-01-02T03:04:05"
    found = doc["layout"]
    assert found["number"] == 3 and found["outline"] == [{"page": 1, "title": "part b", "level": 1}]
    texts = [x["text"] for x in found["lines"]]
    assert all(x in texts for x in lines) and texts[0] == "Sample report page 1"
    assert found["tables"][0]["block"]["header"] == [] or found["tables"][0]["block"]["header"] == ["Name", "Size"]
    assert found["tables"][0]["block"]["rows"][-1] == ["first café", "1"]
    files = spark.createDataFrame([(1, "a.pdf", bytearray(data), len(data))], "doc_id long, filename string, content binary, size_bytes long")
    row = sheafwork.convert(files, sheafwork.ConvertOptions(frontmatter=False)).first()
    assert row["format"] == "pdf" and json.loads(row["metadata"])["removed_running_text"] == ["sample report page #"]
    assert [b["text"] for b in row["blocks"] if b["type"] == "heading"] == ["Part b", "Part c", "Part d"]
    assert "| Name" in row["markdown"] and "Sample report" not in row["markdown"]


def page_of(*content, rotate=""):
    """A PDF of one page with Helvetica."""
    body = "\n".join(content).encode()
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Kids [3 0 R] /Count 1 /Type /Pages >> endobj\n"
        + f"3 0 obj << /Type /Page /Parent 2 0 R {rotate} /MediaBox [0 0 600 800] /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >> endobj\n".encode()
        + f"4 0 obj << /Length {len(body)} >> stream\n".encode() + body + b"\nendstream endobj\n5 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj\ntrailer << /Root 1 0 R >>\n"
    )


def pdf_lines(data):
    doc = parse_one(data, "a.pdf", "pdf", O)
    assert doc["error"] is None
    return [x["text"] for x in doc["layout"]["lines"]]


def test_pdf_reading_order():
    left = [f"BT /F 10 Tf 50 {700 - 12 * k} Td (left line {k} of a column) Tj ET" for k in range(5)]
    right = [f"BT /F 10 Tf 320 {700 - 12 * k} Td (right line {k} of a column) Tj ET" for k in range(5)]
    mixed = [x for pair in zip(left, right, strict=True) for x in pair]
    got = pdf_lines(page_of("BT /F 20 Tf 50 740 Td (One title over both of the columns) Tj ET", *mixed))
    assert got == ["One title over both of the columns", *[f"left line {k} of a column" for k in range(5)], *[f"right line {k} of a column" for k in range(5)]]
    assert pdf_lines(page_of("BT /F 10 Tf 0 1 -1 0 300 100 Tm (turned by a quarter) Tj 0 -14 Td (and a second line) Tj ET")) == ["turned by a quarter", "and a second line"]
    assert pdf_lines(page_of("BT 14 TL /F 10 Tf 50 700 Td [(ker) -20 (ned) -400 (words)] TJ T* (x) ' ET", rotate="/Rotate 90"))[0] == "kerned words"
    form = page_of("q 1 0 0 1 0 0 cm BI /W 1 /H 1 ID \x00EI x EI Q BT /F 10 Tf 50 700 Td (after an image) Tj ET")
    assert pdf_lines(form) == ["after an image"]
    assert parse_one(page_of(""), "a.pdf", "pdf", O)["layout"]["lines"] == []
    many = samples.pdf([str(i) for i in range(200)])
    assert "first 2 of 5" in parse_one(many, "a.pdf", "pdf", O.with_(limits=Limits(max_pdf_pages=2)))["warnings"][0]


def test_scanned_pages_are_reported(spark):
    import sheafwork

    data = page_of("0 0 m 10 10 l S")
    row = sheafwork.documents(spark.createDataFrame([(1, "scan.pdf", bytearray(data), len(data))], "doc_id long, filename string, content binary, size_bytes long")).first()
    assert "looks scanned" in row["warnings"][0] and [b["type"] for b in row["blocks"]] == ["page_break"]


def test_pdf_parts():
    import zlib

    from sheafwork.sources import pdf

    assert pdf._read(rb"[1 -2.5 (a\(b\)\101\n(c)) <48 69 2> /Na#6de true null 3 0 R]", 0)[0] == [1, -2.5, b"a(b)A\n(c)", b"Hi ", "Name", True, None, pdf.Ref(3)]
    assert [pdf.glyph(n) for n in ("eacute", "Adieresis", "uni00E9", "three", "comma", "g123", "f_i.alt")] == ["é", "Ä", "é", "3", ",", "", ""]
    rows = bytes([2, 1, 2, 3, 2, 1, 1, 1])
    assert pdf._unpredicted(rows, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert pdf._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf._run_lengths(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])
    assert pdf._inflated(zlib.compress(b"x" * 5000)[:-4]) == b"x" * 5000
    assert parse_one(b"%PDF-1.4\n%%EOF", "a.pdf", "pdf", O)["error"]["code"] == "parse_error"
    locked = samples.pdf(["x"]).replace(b"trailer << ", b"trailer << /Encrypt 9 0 R ")
    assert "encrypted" in parse_one(locked, "a.pdf", "pdf", O)["error"]["message"]


@pytest.mark.parametrize("kind", samples.KINDS)
def test_damaged_files_never_raise(kind):
    data = samples.build(kind, TEXT)
    for k in range(10):
        cut = data[: len(data) * k // 10]
        assert parse_one(cut, f"a.{kind}", sniff(cut, f"a.{kind}"), O)["blocks"] is not None
    for at in range(0, min(64, len(data)), 7):
        bad = data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :]
        assert parse_one(bad, f"a.{kind}", sniff(bad, f"a.{kind}"), O)["blocks"] is not None


@pytest.mark.parametrize("kind", [k for k in samples.KINDS if k != "png"])
def test_samples_hold_the_whole_text(kind):
    lines = [f"begin{i} " + "some words of a long line " * 20 + f"end{i}." for i in range(60)]
    data = samples.build(kind, "\n".join(lines))
    doc = parse_one(data, f"a.{kind}", sniff(data, f"a.{kind}"), O)
    text = json.dumps([doc["blocks"], doc["layout"]], default=str)
    assert all(f"begin{i} " in text and f"end{i}." in text for i in range(60))


def test_own_parser_reaches_the_workers(spark):
    import sheafwork
    from sheafwork.sources import parse as registry
    from sheafwork.sources.model import block, document

    loud = lambda data, name, options: document([block("paragraph", data.decode().upper())])
    files = spark.createDataFrame([(1, "a.csv", bytearray(b"a,b"), 3), (2, "b.shout", bytearray(b"hi"), 2), (3, "c.txt", bytearray(b"hi"), 2)], "doc_id long, filename string, content binary, size_bytes long").repartition(3)
    texts = lambda df: {r["doc_id"]: r["blocks"][0]["text"] for r in df.collect()}
    assert texts(sheafwork.documents(files, parsers={"csv": loud, ".shout": loud})) == {1: "A,B", 2: "HI", 3: "hi"}
    register("csv", loud)
    register(".shout", loud)
    try:
        assert texts(sheafwork.documents(files)) == {1: "A,B", 2: "HI", 3: "hi"}
        assert parse_one(b"hi", "a.shout", "text", O)["blocks"][0]["text"] == "HI"
    finally:
        registry.PARSERS["csv"] = registry._OWN["csv"]
        del registry.PARSERS[".shout"]
    assert texts(sheafwork.documents(files))[1] is None


def test_limits_and_empty():
    assert parse_one(b"", "a.txt", "text", O)["error"]["code"] == "parse_error"
    assert parse_one(b"x" * 99, "a.txt", "text", O.with_(limits=Limits(max_file_bytes=10)))["error"]["code"] == "file_too_large"
    assert parse_one(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a.doc", "ole2", O)["error"]["code"] == "unsupported_format"
