"""Small files of every format made from a text, for queries over tables without binary columns and for tests."""

from __future__ import annotations

import json
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.batches import bounded

KINDS = ("txt", "md", "csv", "json", "jsonl", "html", "xml", "eml", "ipynb", "rtf", "docx", "pptx", "xlsx", "epub", "zip", "py", "png", "pdf")
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def container(parts: dict[str, str | bytes]) -> bytes:
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def _xml(text: str) -> str:
    return escape("".join(c for c in text if c >= " " or c in "\t\n"))


def _p(text: str, style: str = "", extra: str = "") -> str:
    props = f'<w:pPr>{f"<w:pStyle w:val=\"{style}\"/>" if style else ""}{extra}</w:pPr>' if style or extra else ""
    return f'<w:p>{props}<w:r><w:t xml:space="preserve">{_xml(text)}</w:t></w:r></w:p>'


def docx(lines: list[str]) -> bytes:
    grid = "".join("<w:tr>" + "".join(f"<w:tc>{_p(c)}</w:tc>" for c in r) + "</w:tr>" for r in (("Name", "Size"), ("first", "1"), ("second", "2")))
    body = _p("Sample", "Title") + _p("Part one", "Heading1") + "".join(_p(x) for x in lines) + _p("a point", "ListBullet") + _p("a second", "ListBullet2") + f"<w:tbl>{grid}</w:tbl>"
    core = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>A. Writer</dc:creator></cp:coreProperties>'
    return container({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>', "docProps/core.xml": core})


def pptx(lines: list[str]) -> bytes:
    p, a = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"

    def shape(texts: list[tuple[int, str]], y: int, kind: str = "") -> str:
        ph = f'<p:nvPr><p:ph type="{kind}"/></p:nvPr>' if kind else "<p:nvPr/>"
        paras = "".join(f'<a:p><a:pPr lvl="{d}"/><a:r><a:t>{_xml(t)}</a:t></a:r></a:p>' for d, t in texts)
        return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="s"/>{ph}</p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody>{paras}</p:txBody></p:sp>'

    slides = [shape([(0, "below"), (1, "nested")], 900) + shape([(0, lines[0] if lines else "x")], 100) + shape([(0, "First slide")], 0, "title"), shape([(0, x) for x in lines] or [(0, "y")], 10)]
    parts = {f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>' for i, s in enumerate(slides, 1)}
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in range(1, len(slides) + 1))
    rels = "".join(f'<Relationship Id="r{i}" Type="{_REL}/slide" Target="slides/slide{i}.xml"/>' for i in range(1, len(slides) + 1))
    return container({"ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{_REL}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{_PKG}">{rels}</Relationships>'} | parts)


def xlsx(lines: list[str]) -> bytes:
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    text = lambda ref, x: f'<c r="{ref}" t="inlineStr"><is><t>{_xml(x)}</t></is></c>'
    rows = [text("A1", "Month") + text("B1", "Sum") + text("C1", "Growth"), text("A2", "Jan") + '<c r="B2" s="1"><v>1234.5</v></c><c r="C2" s="2"><v>0.25</v></c>', text("A3", "Feb") + '<c r="B3" s="1"><v>-890</v></c><c r="C3" s="3"><v>45292</v></c>', "", *(text(f"A{i}", x) for i, x in enumerate(lines or ["note"], 5))]
    data = "".join(f'<row r="{i}">{r}</row>' for i, r in enumerate(rows, 1))
    styles = f'<styleSheet xmlns="{s}"><numFmts><numFmt numFmtId="164" formatCode="&quot;$&quot;#,##0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="9"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    book = f'<workbook xmlns="{s}" xmlns:r="{_REL}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/><sheet name="Scratch" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>'
    rels = f'<Relationships xmlns="{_PKG}"><Relationship Id="r1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_REL}/worksheet" Target="worksheets/sheet2.xml"/></Relationships>'
    sheet = lambda d: f'<worksheet xmlns="{s}"><sheetData>{d}</sheetData></worksheet>'
    return container({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/styles.xml": styles, "xl/worksheets/sheet1.xml": sheet(data), "xl/worksheets/sheet2.xml": sheet(f'<row r="1">{text("A1", "hidden")}</row>')})


def epub(lines: list[str]) -> bytes:
    opf = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>A Book</dc:title><dc:creator>A. Writer</dc:creator></metadata><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="gone"/></spine></package>'
    page = lambda t, x: f"<html><head><title>{t}</title></head><body>{x}</body></html>"
    body = "".join(f"<p>{_xml(x)}</p>" for x in lines)
    return container({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/book.opf"/></rootfiles></container>', "o/book.opf": opf, "o/a.xhtml": page("One", "<h1>Chapter one</h1>" + body), "o/b.xhtml": page("Two", "<p>no heading here</p>")})


def pdf(lines: list[str], rows: int = 40, packed: bool = False) -> bytes:
    """Pages of lines under a large heading, with running lines, a ruled table on the last page, a table of contents and facts."""
    objects: dict[int, bytes] = {}
    named = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    code = lambda t: "<" + t.encode("utf-16-be", "replace").hex() + ">"

    def stream(head: str, body: bytes) -> bytes:
        squeezed = zlib.compress(body)
        return f"<< {head} /Length {len(squeezed)} /Filter /FlateDecode >> stream\n".encode() + squeezed + b"\nendstream"

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>"
    objects[3] = b"<< /First 4 0 R /Last 4 0 R /Count 1 >>"
    objects[5] = b"<< /Title (Sample) /Author (A. Writer) /CreationDate (D:20240102030405Z) >>"
    objects[6] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Sample /Encoding /Identity-H /DescendantFonts [7 0 R] /ToUnicode 8 0 R >>"
    objects[7] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Sample /DW 500 >>"
    objects[8] = stream("", cmap)
    objects[9] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /fi] >> >>"
    pages = [lines[i : i + rows] for i in range(0, len(lines), rows)] or [[]]
    kids = []
    for n, part in enumerate(pages, 1):
        text = [f"BT /F2 8 Tf 50 800 Td (Sample report page {n}) Tj ET", f"BT /F1 24 Tf 50 760 Td {code(f'Part {named(n)}')} Tj ET"]
        text += [f"BT /F1 11 Tf 50 {740 - 16 * k} Td {code(x)} Tj ET" for k, x in enumerate(part)]
        if n == len(pages):
            at = 700 - 16 * rows
            text += [f"{x} {at} m {x} {at + 40} l S" for x in (50, 150, 250)] + [f"50 {y} m 250 {y} l S" for y in (at, at + 20, at + 40)]
            text += [f"BT /F2 11 Tf 1 0 0 1 {x} {y} Tm ({c}) Tj ET" for x, y, c in ((55, at + 26, "Name"), (155, at + 26, "Size"), (55, at + 6, "\\002rst caf\\001"), (155, at + 6, "1"))]
        objects[20 + 2 * n] = f"<< /Type /Page /Parent 2 0 R /Contents {21 + 2 * n} 0 R >>".encode()
        objects[21 + 2 * n] = stream("", "\n".join(text).encode())
        kids.append(f"{20 + 2 * n} 0 R")
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} /MediaBox [0 0 595 842] /Resources << /Font << /F1 6 0 R /F2 9 0 R >> >> >>".encode()
    objects[4] = f"<< /Title <{'FEFF' + f'Part {named(1)}'.encode('utf-16-be').hex()}> /Parent 3 0 R /Dest [{kids[0]} /Fit] >>".encode()
    if packed:  # all but the streams in one
        inner = {n: o for n, o in objects.items() if b"stream" not in o}
        at, index, body = 0, [], b""
        for n, o in inner.items():
            index.append(f"{n} {at}")
            body += o + b"\n"
            at = len(body)
        head = " ".join(index).encode() + b"\n"
        objects = {n: o for n, o in objects.items() if n not in inner} | {10: stream(f"/Type /ObjStm /N {len(inner)} /First {len(head)}", head + body), 11: stream("/Type /XRef /Root 1 0 R /Info 5 0 R /Size 12 /W [1 2 1]", b"")}
    out = b"%PDF-1.5\n" + b"".join(f"{n} 0 obj\n".encode() + o + b"\nendobj\n" for n, o in objects.items())
    return out + (b"" if packed else b"trailer << /Root 1 0 R /Info 5 0 R >>\n") + b"%%EOF\n"


def build(kind: str, text: str) -> bytes:
    lines = [x for x in text.split("\n") if x.strip()]
    plain = "\n\n".join(["SAMPLE TITLE", *lines, "- one\n- two"])
    if kind == "md":
        return f"---\ntitle: Sample\n---\n# Sample\n\n{plain}\n".encode()
    if kind == "csv":
        return ("Month,Sum,Note\r\n" + "\r\n".join(f'M{i},{i * 10},"{x.replace(chr(34), chr(34) * 2)}"' for i, x in enumerate(lines)) + "\r\n").encode()
    if kind == "json":
        return json.dumps({"product": "sample", "formats": ["a", "b"], "lines": [{"n": i, "text": x} for i, x in enumerate(lines)], "deep": {"x": {"y": None}}}, ensure_ascii=False).encode()
    if kind == "jsonl":
        return "\n".join([*(json.dumps({"id": i, "text": x}) for i, x in enumerate(lines)), "{broken"]).encode()
    if kind == "html":
        return f"<html><head><title>Sample</title></head><body><nav>menu</nav><main><h1>Sample</h1>{''.join(f'<p>{_xml(x)}' for x in lines)}<ul><li>one<ul><li>nested</ul></ul><table><tr><th>a<th>b<tr><td>1<td>2</table></main></body></html>".encode()
    if kind == "xml":
        return f'<?xml version="1.0"?><root id="1">{"".join(f"<line n=\"{i}\">{_xml(x)}</line>" for i, x in enumerate(lines))}<group><a>1</a><b>2</b></group></root>'.encode()
    if kind == "eml":
        return ("From: a@example.com\r\nTo: b@example.com\r\nSubject: Sample\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n" + plain).encode()
    if kind == "ipynb":
        cells = [{"cell_type": "markdown", "source": ["# Sample\n", "intro"]}, {"cell_type": "code", "source": ["print(1)"], "outputs": [{"output_type": "stream", "name": "stdout", "text": ["1\n"]}]}, {"cell_type": "markdown", "source": plain}]
        return json.dumps({"cells": cells, "metadata": {"kernelspec": {"language": "python", "display_name": "Python"}}, "nbformat": 4}).encode()
    if kind == "rtf":
        body = "\\par ".join("".join(c if c < "\x80" and c not in "\\{}" else f"\\u{ord(c)}?" if ord(c) < 32768 else "?" for c in x) for x in lines)
        return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}\\b Sample\\b0\\par " + body + "}").encode("latin-1", "replace")
    if kind in ("docx", "pptx", "xlsx", "epub"):
        return {"docx": docx, "pptx": pptx, "xlsx": xlsx, "epub": epub}[kind](lines)
    if kind == "zip":
        return container({"notes.md": f"# Notes\n\n{plain}", "data.csv": "a,b\n1,2\n", "__MACOSX/junk": "x", "inner.zip": container({"deep.txt": "DEEP TITLE\n\ntext."})})
    if kind == "py":
        return "\n".join(["def f():\n    return 1", *(f"# {x}" for x in lines), ""]).encode()
    if kind == "png":
        return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (3).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"
    if kind == "pdf":
        return pdf(lines)
    return plain.encode()


def files(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: str | None = None) -> DataFrame:
    """One file per row, of the kind or of one that follows from the key: doc_id, filename, content, size_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [kind or KINDS[k % len(KINDS)] for k in batch.column(0).to_pylist()]
            made = [build(k, t or "") for k, t in zip(kinds, batch.column(1).to_pylist(), strict=True)]
            names = [f"file_{i}.{k}" for i, k in zip(batch.column(0).to_pylist(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(made, pa.binary()), pa.array([len(x) for x in made], pa.int64())], ["doc_id", "filename", "content", "size_bytes"])

    bounded(docs.sparkSession)
    return docs.select(docs[key].cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, filename string, content binary, size_bytes long")
