"""All registered queries of the ingestion engine: name -> (function of session and folder, DuckDB SQL or None)."""

from __future__ import annotations

from . import queries_convert, queries_layout, queries_tables, queries_text

QUERIES = {**queries_text.QUERIES, **queries_tables.QUERIES, **queries_layout.QUERIES, **queries_convert.QUERIES}
