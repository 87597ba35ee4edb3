"""ZIP archives: guards over their directories, and conversion of their members."""

from __future__ import annotations

import io
import re
import zipfile
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import IGNORED_NAMES, IGNORED_PREFIXES
from ..options import Limits
from .mail import size
from .model import SourceError, block, document


def guards(members: DataFrame, limits: Limits | None = None, key: str = "archive_id") -> DataFrame:
    """(key, members, file_size, compress_size, breach) per archive. members: key, file_size, compress_size of the wanted members.

    breach: bytes or ratio refuse the archive, members truncates it, null is none.
    """
    o = limits or Limits()
    per = members.groupBy(key).agg(F.count("*").alias("members"), F.sum("file_size").alias("file_size"), F.greatest(F.lit(1), F.sum("compress_size")).alias("compress_size"))
    breach = F.when(F.col("file_size") > o.max_archive_bytes, "bytes").when(F.col("file_size") > o.max_archive_ratio * F.col("compress_size"), "ratio").when(F.col("members") > o.max_archive_members, "members")
    return per.withColumn("breach", breach)


def members(data: bytes, limits: Limits) -> tuple[list[tuple[str, bytes | None, str | None]], int, list[str]]:
    """((name, content, error) of the wanted members, bytes unpacked, warnings); raises where a guard refuses the archive."""
    try:
        box = zipfile.ZipFile(io.BytesIO(data))
    except Exception as e:
        raise SourceError("parse_error", f"The archive can't be opened: {e}") from e
    with box:
        wanted = [m for m in box.infolist() if _wanted(m.filename)]
        total, packed = sum(m.file_size for m in wanted), sum(m.compress_size for m in wanted) or 1
        if total > limits.max_archive_bytes:
            raise SourceError("limit_exceeded", f"The archive unpacks to {size(total)}; the limit is {size(limits.max_archive_bytes)}.")
        if total > limits.max_archive_ratio * packed:
            raise SourceError("limit_exceeded", f"The archive's compression ratio is over {limits.max_archive_ratio} to 1.")
        warnings = [f"Only the first {limits.max_archive_members} of {len(wanted)} members are converted."] if len(wanted) > limits.max_archive_members else []
        out: list[tuple[str, bytes | None, str | None]] = []
        for m in wanted[: limits.max_archive_members]:
            try:
                out.append((m.filename, box.read(m), None))
            except Exception as e:
                out.append((m.filename, None, str(e)))
    return out, total, warnings


def _wanted(name: str) -> bool:
    parts = name.split("/")
    return not (name.endswith("/") or name.startswith("/") or ".." in parts or parts[-1] in IGNORED_NAMES or any(f"/{p}" in f"/{name}" for p in IGNORED_PREFIXES))


def parse_archive(data: bytes, name: str, options: Any, depth: int = 0) -> dict[str, Any]:
    """Every member converted in turn, its headings two levels deeper; a member that fails is a note, not an error."""
    from .parse import parse_one, sniff

    if depth >= options.limits.max_recursion_depth:
        raise SourceError("limit_exceeded", f"Archives are nested deeper than {options.limits.max_recursion_depth}.")
    found, total, warnings = members(data, options.limits)
    out: list[dict[str, Any]] = [block("key_values", kv=[("Files", str(len(found))), ("Unpacked", size(total))])]
    assets: list[dict[str, Any]] = []
    converted = 0
    for member, content, error in found:
        out += [block("rule"), block("heading", member, level=2)]
        if content is None:
            warnings.append(f"{member}: {error}")
            continue
        kind = sniff(content, member)
        if kind in ("binary", "image") and not options.ocr:
            out.append(block("paragraph", f"*{kind.capitalize()} member of {size(len(content))}; not converted.*"))
            continue
        child = parse_one(content, member, kind, options, depth + 1)
        if child["error"]:
            out.append(block("paragraph", f"*Skipped: {child['error']['message']}*"))
            warnings.append(f"{member}: {child['error']['message']}")
            continue
        converted += 1
        if child["title"] and child["title_source"] != "filename" and not child["passthrough"]:
            out.append(block("heading", child["title"], level=3))
        for b in child["blocks"]:
            if b["type"] == "heading":
                b["level"] = min(6, (b["level"] or 1) + 2)
            elif b["type"] == "plain":
                b["level"] = (b["level"] or 0) + 2
            elif b["type"] == "raw":
                b["text"] = _deeper(b["text"] or "", 2)
            out.append(b)
        warnings += [f"{member}: {w}" for w in child["warnings"]]
        for a in child["assets"][: options.limits.max_assets - len(assets)]:
            n = len(assets) + 1
            assets.append(a | {"asset_id": f"img-{n:03d}", "filename": f"img-{n:03d}-{a['filename'].rpartition('/')[2]}"})
    if not converted:
        warnings.append("No member of the archive could be converted.")
    return document(out, None, metadata={"members": len(found), "converted": converted}, warnings=warnings, assets=assets)


def _deeper(text: str, by: int) -> str:
    out, fenced = [], False
    for line in text.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})(?=\s|$)", line)):
            line = "#" * min(6, len(m[1]) + by) + line[len(m[1]) :]
        out.append(line)
    return "\n".join(out)
