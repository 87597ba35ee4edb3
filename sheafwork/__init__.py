"""sheafwork: document ingestion and analytics expressed as Spark DataFrames."""

from .functions.detect import parsers, supported_formats
from .functions.detect import with_detection as detect
from .options import ConvertOptions, Limits
from .plans.chunk import chunks as chunk_documents
from .plans.chunk import to_jsonl
from .plans.convert import chunks, compare, convert, documents, one, window
from .plans.sinks import bundles, document_json, receipts, unique_stems, write_json, write_jsonl, write_markdown, write_tables
from .sources.model import SourceError
from .sources.parse import register
from .sources.read import column, files

__version__ = "0.1.0"


def formats(spark):
    """(format, label) of every format that is read."""
    return supported_formats(parsers(spark))


__all__ = [
    "ConvertOptions", "Limits", "SourceError", "bundles", "chunk_documents", "chunks", "column", "compare", "convert", "detect", "document_json", "documents", "files", "formats", "one", "receipts",
    "register", "to_jsonl", "unique_stems", "window", "write_json", "write_jsonl", "write_markdown", "write_tables",
]
