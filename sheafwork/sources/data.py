"""Delimited text, JSON, JSON Lines and notebooks."""

from __future__ import annotations

import base64
import csv
import io
import json
from itertools import islice
from typing import Any

from .model import asset, block, document, table
from .plain import clean, decode

DEPTH = 40
_MARKS = ",;\t|"


def _mark(text: str) -> str:
    """The delimiter: the one by which the first rows have the most cells, all rows alike, else what the sniffer or the count says.

    A row is read with its quotes, so marks and quotes inside a cell don't count.
    """
    widths = {}
    for mark in _MARKS:
        try:
            sizes = {len(row) for row in islice(csv.reader(io.StringIO(text, newline=""), delimiter=mark), 20) if row}
        except csv.Error:
            continue
        widths[mark] = max(sizes) if len(sizes) == 1 else 0
    if max(widths.values(), default=0) > 1:
        return max(widths, key=widths.__getitem__)
    sample = "\n".join(text.splitlines()[:20])
    try:
        return csv.Sniffer().sniff(sample, _MARKS).delimiter
    except csv.Error:
        return max(_MARKS, key=sample.count)


def _has_header(text: str, mark: str) -> bool | None:
    sniffer = csv.Sniffer()
    if mark in text:
        sniffer.sniff = lambda *_: type("known", (csv.excel,), {"delimiter": mark})  # its own guess knows nothing of the one made
    try:
        return sniffer.has_header("\n".join(text.splitlines()[:30]))
    except (csv.Error, StopIteration):
        return None


def parse_delimited(data: bytes, name: str, options: Any, mark: str | None = None) -> dict[str, Any]:
    text = decode(data)
    csv.field_size_limit(max(csv.field_size_limit(), len(text)))  # a cell may be as long as the file, whose size has a limit
    mark = mark or _mark(text)
    hint = _has_header(text, mark)
    rows, warnings = [], []
    try:
        for row in csv.reader(io.StringIO(text, newline=""), delimiter=mark):
            if len(rows) == options.limits.max_csv_rows:
                warnings.append(f"Only the first {len(rows)} rows are kept.")
                break
            rows.append(row)
    except csv.Error as e:
        warnings.append(f"Reading stopped at a malformed row: {e}.")
    made = table(rows, hint)
    facts = {"delimiter": mark, "rows": len(rows), "columns": max(map(len, rows), default=0)}
    return document([made] if made else [], None, metadata=facts, warnings=warnings or ([] if made else ["The file holds no rows."]))


def parse_tsv(data: bytes, name: str, options: Any) -> dict[str, Any]:
    return parse_delimited(data, name, options, "\t")


def _flat(v: Any) -> bool:
    return not isinstance(v, dict | list)


def shown(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if _flat(v) else json.dumps(v, ensure_ascii=False)


def _is_table(v: list[Any]) -> bool:
    if len(v) < 2 or not all(isinstance(x, dict) and all(map(_flat, x.values())) for x in v) or not v[0]:
        return False
    first = v[0].keys()
    return sum(len(first & x.keys()) / len(first | x.keys()) for x in v) > 0.7 * len(v)


def value_blocks(v: Any, level: int = 2, name: str | None = None, depth: int = 0) -> list[dict[str, Any]]:
    """A JSON value: uniform objects as a table, scalars as a list, objects as pairs and then their nested members."""
    level = min(level, 6)
    head = [block("heading", name, level=level)] if name else []
    if depth > DEPTH:
        return [*head, block("paragraph", shown(v))]
    if isinstance(v, list):
        if _is_table(v):
            names = list(dict.fromkeys(k for x in v for k in x))
            made = table([[shown(x.get(k)) for k in names] for x in v], header=names)
            return head + ([made] if made else [])
        if v and all(map(_flat, v)):
            return [*head, block("list", items=[(0, shown(x), None) for x in v])]
        return head + [b for i, x in enumerate(v, 1) for b in value_blocks(x, level + 1, f"[{i}]", depth + 1)]
    if isinstance(v, dict):
        pairs = [(k, shown(x)) for k, x in v.items() if _flat(x)]
        return head + ([block("key_values", kv=pairs)] if pairs else []) + [b for k, x in v.items() if not _flat(x) for b in value_blocks(x, level + 1, k, depth + 1)]
    return [block("paragraph", f"**{name}:** {shown(v)}" if name else shown(v))]


def parse_json(data: bytes, name: str, options: Any) -> dict[str, Any]:
    text = decode(data)
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return document([block("code", text.rstrip(), lang="json")], warnings=["The JSON is not valid; kept as it is."])
    return document(value_blocks(v), metadata={"json_root": type(v).__name__})


def parse_jsonl(data: bytes, name: str, options: Any) -> dict[str, Any]:
    values, bad, warnings = [], 0, []
    for line in decode(data).splitlines():
        if not line.strip():
            continue
        if len(values) == options.limits.max_csv_rows:
            warnings.append(f"Only the first {len(values)} records are kept.")
            break
        try:
            values.append(json.loads(line))
        except (ValueError, RecursionError):
            bad += 1
    if bad:
        warnings.append(f"{bad} lines are not valid JSON.")
    return document(value_blocks(values), metadata={"records": len(values)}, warnings=warnings)


def _joined(v: Any) -> str:
    return "".join(map(str, v)) if isinstance(v, list) else str(v or "")


def parse_notebook(data: bytes, name: str, options: Any) -> dict[str, Any]:
    from .model import SourceError

    try:
        book = json.loads(decode(data))
        cells = book.get("cells") or [c for w in book.get("worksheets", []) for c in w.get("cells", [])]
    except (ValueError, AttributeError, RecursionError) as e:
        raise SourceError("parse_error", f"Not a notebook: {e}") from e
    meta = book.get("metadata") or {}
    kernel = meta.get("kernelspec") or {}
    lang = kernel.get("language") or (meta.get("language_info") or {}).get("name") or "python"
    out: list[dict[str, Any]] = []
    assets: list[dict[str, Any]] = []
    title = None
    for cell in cells:
        kind, source = cell.get("cell_type"), _joined(cell.get("source", cell.get("input")))
        if kind == "markdown":
            if title is None and not out and source.lstrip().startswith("# "):
                title, _, source = source.lstrip()[2:].partition("\n")
            if source.strip():
                out.append(block("raw", source.strip()))
        elif kind == "code":
            if source.strip():
                out.append(block("code", source.rstrip(), lang=lang))
            for o in cell.get("outputs") or []:
                out += _output(o, assets, options)
        elif source.strip():
            out.append(block("code", source.rstrip(), lang="text"))
    return document(out, (title or "").strip(), "heading", {"language": lang, "kernel": kernel.get("display_name"), "cells": len(cells)}, assets=assets)


def _output(o: dict[str, Any], assets: list[dict[str, Any]], options: Any) -> list[dict[str, Any]]:
    kind = o.get("output_type")
    if kind == "stream":
        text = _joined(o.get("text")).rstrip()
        return [block("code", text, lang="text")] if text else []
    if kind in ("error", "pyerr"):
        return [block("quote", f"{o.get('ename', 'Error')}: {o.get('evalue', '')}")]
    data = o.get("data") or {}
    if "text/markdown" in data:
        return [block("raw", _joined(data["text/markdown"]).strip())]
    if "image/png" in data and len(assets) < options.limits.max_assets:
        try:
            raw = base64.b64decode(_joined(data["image/png"]))
        except ValueError:
            raw = b""
        if raw:
            a = asset(len(assets) + 1, f"img-{len(assets) + 1:03d}.png", "image/png", raw)
            assets.append(a)
            return [block("image", "output", src=f"{options.asset_dir}/{a['filename']}")]
    if "text/html" in data:
        from .html import blocks, tree

        return blocks(tree(_joined(data["text/html"])))
    text = clean(_joined(data.get("text/plain"))) if "text/plain" in data else ""
    return [block("code", text, lang="text")] if text else []
