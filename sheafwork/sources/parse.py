"""The registry of parsers and the Arrow stage that runs them over rows of bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.batches import BYTES, ROWS, bounded
from ..functions.detect import BARE_NAMES, CODE, FORMATS
from ..options import ConvertOptions
from ..schema import DOCUMENT
from .archive import parse_archive
from .data import parse_delimited, parse_json, parse_jsonl, parse_notebook, parse_tsv
from .html import parse_html, parse_xml
from .image import parse_image
from .mail import parse_email
from .model import SourceError, failure
from .office import parse_docx, parse_epub, parse_pptx, parse_xlsx
from .pdf import parse_pdf
from .plain import parse_code, parse_markdown, parse_text
from .rtf import parse_rtf

Parser = Callable[..., dict[str, Any]]
#: Bytes of files whose documents are handed on together.
_TOGETHER = BYTES


def _legacy(data: bytes, name: str, options: Any) -> dict[str, Any]:
    raise SourceError("unsupported_format", "Legacy Office files are not read; save the file in a current format first.")


PARSERS: dict[str, Parser] = {
    "pdf": parse_pdf, "docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "epub": parse_epub, "ipynb": parse_notebook, "markdown": parse_markdown, "eml": parse_email, "html": parse_html,
    "code": parse_code, "csv": parse_delimited, "tsv": parse_tsv, "json": parse_json, "jsonl": parse_jsonl, "xml": parse_xml, "rtf": parse_rtf, "ole2": _legacy, "image": parse_image, "zip": parse_archive,
    "text": parse_text, "binary": parse_text,
}


def register(fmt: str, parser: Parser) -> None:
    """Use a parser for a format, or for a file extension such as ".xyz"; it takes (data, filename, options) and returns ``model.document`` rows.

    ``parsed`` sends the registered parsers to the workers, so a parser has to be
    importable there or to be picklable by value, as functions of a notebook are.
    """
    PARSERS[fmt] = parser


#: The parsers of a worker's current stage that are not this package's own; archives look their members' parsers up here.
_SENT: dict[str, Parser] = {}
_OWN = dict(PARSERS)


def sniff(data: bytes, name: str) -> str:
    """Format of a member of an archive: the rules of ``functions.detect`` for one value in Python."""
    heads = ((b"%PDF-", "pdf"), (b"{\\rtf", "rtf"), (b"\x89PNG\r\n\x1a\n", "image"), (b"\xff\xd8\xff", "image"), (b"GIF87a", "image"), (b"GIF89a", "image"), (b"II*\x00", "image"), (b"MM\x00*", "image"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole2"))
    for head, fmt in heads:
        if data.startswith(head):
            return fmt
    if data[:2] == b"BM" and data[6:10] == b"\x00" * 4 or data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image"
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist()[:400])
        except Exception:
            return "zip"
        if "word/document.xml" in names:
            return "docx"
        if "ppt/presentation.xml" in names or any(n.startswith("ppt/slides/") for n in names):
            return "pptx"
        if "xl/workbook.xml" in names:
            return "xlsx"
        return "epub" if "META-INF/container.xml" in names or any(n.endswith(".opf") for n in names) else "zip"
    base = name.rpartition("/")[2].lower()
    ext = base[base.rfind(".") :] if "." in base[1:] else ""
    if ext in dict(CODE) or base in dict(BARE_NAMES):
        return "code"
    for fmt, _, exts in FORMATS:
        if ext in exts:
            return fmt
    if b"\x00" in data[:4096]:
        return "binary"
    shape = data[:4096].lstrip().lower()
    if shape[:1] in (b"{", b"["):
        return "json"
    return "html" if shape.startswith((b"<!doctype html", b"<html")) else "xml" if shape.startswith(b"<?xml") else "text"


def parse_one(data: bytes | None, name: str, fmt: str, options: ConvertOptions, depth: int = 0) -> dict[str, Any]:
    """One file; whatever goes wrong becomes its ``error``, never an exception."""
    try:
        if not data:
            raise SourceError("parse_error", "The file is empty.")
        if len(data) > options.limits.max_file_bytes:
            raise SourceError("file_too_large", f"The file is over the limit of {options.limits.max_file_bytes} bytes.")
        base = name.rpartition("/")[2].lower()
        parser = _SENT.get("." + base.rpartition(".")[2]) or _SENT.get(fmt) or PARSERS.get("." + base.rpartition(".")[2]) or PARSERS.get(fmt, parse_text)
        return parser(data, name, options, depth) if parser is parse_archive else parser(data, name, options)
    except SourceError as e:
        return failure(e.code, str(e))
    except Exception as e:
        return failure("parse_error", f"{type(e).__name__}: {e}")


def parsed(files: DataFrame, options: ConvertOptions, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Adds the columns of ``schema.DOCUMENT`` to rows of (filename, content, detection.format); ``content`` goes.

    Files over the size limit never reach Python. Batches are bounded in bytes.
    parsers: by format or extension, used before the registered ones.
    """
    sent = {k: v for k, v in PARSERS.items() if _OWN.get(k) is not v} | (parsers or {})
    bounded(files.sparkSession)
    keep = [c for c in files.columns if c != "content"]
    kept = StructType([files.schema[c] for c in keep])
    made = StructType.fromDDL(DOCUMENT)
    arrow = to_arrow_schema(made)
    at = {c: files.columns.index(c) for c in files.columns}
    # A source that leaves out the content of large files still says their size.
    size = F.greatest(F.octet_length("content").cast("long"), F.col("size_bytes")) if "size_bytes" in files.columns else F.octet_length("content").cast("long")
    rows = files.withColumn("__size", size).withColumn("content", F.when(F.octet_length("content") <= options.limits.max_file_bytes, F.col("content")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sheafwork.sources import parse as here  # a worker serves several stages in turn

        here._SENT.clear()
        here._SENT.update(sent)
        for batch in batches:
            fmt = batch.column(at["detection"]).field("format").to_pylist()
            names = batch.column(at["filename"]).to_pylist()
            sizes = batch.column(batch.num_columns - 1).to_pylist()
            begin, weight, docs = 0, 0, []
            for i in range(batch.num_rows):
                data = batch.column(at["content"])[i].as_py()
                if data is None and (sizes[i] or 0) > options.limits.max_file_bytes:
                    docs.append(failure("file_too_large", f"The file is over the limit of {options.limits.max_file_bytes} bytes."))
                else:
                    docs.append(here.parse_one(data, names[i] or "", fmt[i], options))
                weight += sizes[i] or 0
                if weight >= _TOGETHER or len(docs) == ROWS or i + 1 == batch.num_rows:  # bounded in bytes, however large the files
                    part = batch.slice(begin, len(docs))
                    fields = [pa.array([d[f.name] for d in docs], f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays([*(part.column(at[c]) for c in keep), *fields], [*keep, *arrow.names])
                    begin, weight, docs = i + 1, 0, []

    return rows.mapInArrow(run, StructType(kept.fields + made.fields))
