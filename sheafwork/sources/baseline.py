"""What a plain text extraction gives of a file, for comparison: no structure, no parser of ``parse``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.batches import bounded
from .office import A, P, S, W, Package, _column
from .pdf import File, Page, _pages, lines_of
from .plain import clean, decode

#: Characters of a baseline that are kept.
LONGEST = 200_000


def _docx(data: bytes) -> str:
    """Paragraphs of the body alone, so text in tables is not in it."""
    body = Package(data).xml("word/document.xml").find(W + "body")
    return "\n".join("".join(t.text or "" for t in p.iter(W + "t")) for p in body.findall(W + "p"))


def _pptx(data: bytes) -> str:
    pkg = Package(data)
    links = pkg.links("ppt/presentation.xml")
    out = []
    for part in (links[x.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")][1] for x in pkg.xml("ppt/presentation.xml").iter(P + "sldId")):
        tree = pkg.xml(part).find(f"{P}cSld/{P}spTree")
        for body in (shape.find(P + "txBody") for shape in tree.findall(P + "sp")):
            if body is not None:
                out.append("\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in body.findall(A + "p")))
    return "\n".join(out)


def _xlsx(data: bytes) -> str:
    """The stored values of every row, without their formats; dates are numbers here."""
    pkg = Package(data)
    strings = pkg.xml("xl/sharedStrings.xml")
    texts = [] if strings is None else ["".join(t.text or "" for t in si.iter(S + "t")) for si in strings.findall(S + "si")]
    out = []
    for part in sorted((n for n in pkg.names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (_column(n), len(n), n)):
        for row in pkg.xml(part).iter(S + "row"):
            values = []
            for c in row.findall(S + "c"):
                v = c.findtext(S + "v")
                text = "".join(t.text or "" for t in c.iter(S + "t")) if c.get("t") == "inlineStr" else texts[int(v)] if c.get("t") == "s" and v else v
                if text:
                    values.append(text)
            if values:
                out.append(" ".join(values))
    return "\n".join(out)


def _markup(data: bytes) -> str:
    """Every text between tags, scripts and chrome included."""
    text = re.sub(r"(?s)<!--.*?-->|<[!?/a-zA-Z][^>]*>", "\n", decode(data))
    return re.sub(r"\n\s*\n+", "\n", unescape(text))


def _pdf(data: bytes) -> str:
    file = File(data)
    fonts: dict = {}
    return "\n".join(line.text for _, head in _pages(file) for line in lines_of(Page(file, head, fonts).glyphs))


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"pdf": _pdf, "docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "html": _markup, "xml": _markup}


def text_of(data: bytes | None, fmt: str) -> str:
    """The baseline of one file; empty where the extraction fails."""
    try:
        return EXTRACTORS.get(fmt, lambda x: clean(decode(x)))(data or b"")[:LONGEST].strip()
    except Exception:
        return ""


def with_baseline(files: DataFrame) -> DataFrame:
    """(doc_id, baseline) of rows of (doc_id, content, detection)."""
    bounded(files.sparkSession)
    rows = files.select("doc_id", "content", "detection.format")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(data.as_py(), fmt) for data, fmt in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "baseline"])

    return rows.mapInArrow(run, StructType([files.schema["doc_id"], StructField("baseline", StringType())]))
