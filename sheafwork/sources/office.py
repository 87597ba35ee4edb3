"""Word, PowerPoint and Excel files: ZIP containers of XML, read with the standard library."""

from __future__ import annotations

import datetime as dt
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from decimal import Decimal
from io import BytesIO
from typing import Any

from .model import SourceError, asset, block, document, table

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Fonts of code; core properties and their names here.
_MONO = ("courier", "consolas", "mono", "menlo")
_CORE = {"title": "title", "creator": "author", "subject": "subject", "keywords": "keywords", "category": "category", "description": "description", "created": "created", "modified": "modified"}
_IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp"}


class Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(BytesIO(data))
            self.names = set(self.zip.namelist())
        except Exception as e:
            raise SourceError("parse_error", f"The container can't be opened: {e}") from e

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        try:
            return ET.fromstring(self.zip.read(name))
        except Exception as e:
            raise SourceError("parse_error", f"{name} can't be read: {e}") from e

    def links(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """Relations of a part: id -> (kind, target, external)."""
        folder, base = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        out = {}
        for r in [] if root is None else root:
            outside = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not outside:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target, outside)
        return out

    def facts(self) -> dict[str, str]:
        root = self.xml("docProps/core.xml")
        found = {} if root is None else {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in root}
        return {out: found[k] for k, out in _CORE.items() if found.get(k)}

    def images(self, parts: list[str], limits: Any, have: int = 0) -> tuple[list[dict[str, Any]], bool]:
        out: list[dict[str, Any]] = []
        for part in parts:
            ext = posixpath.splitext(part)[1].lower()
            if ext not in _IMAGES or part not in self.names or self.zip.getinfo(part).file_size < limits.min_asset_bytes:
                continue
            if have + len(out) >= limits.max_assets:
                return out, True
            n = have + len(out) + 1
            out.append(asset(n, f"img-{n:03d}{ext}", _IMAGES[ext], self.zip.read(part)))
        return out, False


def _on(props: ET.Element | None, tag: str) -> bool:
    node = None if props is None else props.find(W + tag)
    return node is not None and node.get(W + "val", "1") not in ("0", "false", "none")


def _marked(text: str, mark: str) -> str:
    bare = text.strip()
    return text.replace(bare, f"{mark}{bare}{mark}", 1) if bare else text


def _runs(node: ET.Element, links: dict[str, tuple[str, str, bool]]) -> str:
    out: list[tuple[tuple[bool, bool, bool], str]] = []
    for c in node:
        if c.tag == W + "r":
            props = c.find(W + "rPr")
            fonts = None if props is None else props.find(W + "rFonts")
            face = "" if fonts is None else (fonts.get(W + "ascii") or "").lower()
            style = (_on(props, "b"), _on(props, "i"), any(m in face for m in _MONO))
            text = "".join({W + "t": e.text or "", W + "tab": "\t", W + "br": "\n" if e.get(W + "type") != "page" else "", W + "noBreakHyphen": "-"}.get(e.tag, "") for e in c)
            if out and out[-1][0] == style:
                out[-1] = (style, out[-1][1] + text)
            elif text:
                out.append((style, text))
        elif c.tag == W + "hyperlink":
            kind, target, outside = links.get(c.get(R + "id", ""), ("", "", False))
            text = _runs(c, links)
            out.append(((False,) * 3, f"[{text.strip()}]({target})" if outside and text.strip() else text))
        elif c.tag in (W + "ins", W + "smartTag", W + "sdt", W + "sdtContent", W + "fldSimple"):
            out.append(((False,) * 3, _runs(c, links)))
    parts = []
    for (bold, italic, mono), text in out:
        for use, mark in ((mono, "`"), (italic, "_"), (bold, "**")):
            if use:
                text = _marked(text, mark)
        parts.append(text)
    return "".join(parts)


def _numbering(pkg: Package) -> dict[tuple[str, int], bool]:
    """(list id, level) -> whether its items are numbered."""
    root = pkg.xml("word/numbering.xml")
    if root is None:
        return {}
    kinds = {}
    for a in root.findall(W + "abstractNum"):
        for level in a.findall(W + "lvl"):
            fmt = level.find(W + "numFmt")
            kinds[a.get(W + "abstractNumId"), int(level.get(W + "ilvl", 0))] = fmt is not None and fmt.get(W + "val") not in ("bullet", "none")
    out = {}
    for n in root.findall(W + "num"):
        ref = n.find(W + "abstractNumId")
        for (abstract, level), numbered in kinds.items():
            if ref is not None and ref.get(W + "val") == abstract:
                out[n.get(W + "numId", ""), level] = numbered
    return out


def _word_table(node: ET.Element, links: dict[str, tuple[str, str, bool]]) -> dict[str, Any] | None:
    rows, marked = [], False
    for i, tr in enumerate(node.findall(W + "tr")):
        props = tr.find(W + "trPr")
        marked |= i == 0 and props is not None and props.find(W + "tblHeader") is not None
        row: list[str] = []
        for tc in tr.iter(W + "tc"):
            cell = tc.find(W + "tcPr")
            span = None if cell is None else cell.find(W + "gridSpan")
            down = None if cell is None else cell.find(W + "vMerge")
            text = "\n".join(t for p in tc.findall(W + "p") if (t := _runs(p, links).strip()))
            row.append("" if down is not None and down.get(W + "val") != "restart" else text)
            row += [""] * (int(span.get(W + "val", 1)) - 1 if span is not None else 0)
        rows.append(row)
    first = [c for c in rows[0] if c.strip()] if rows else []
    numbers = bool(first) and all(re.fullmatch(r"-?[\d,]*\.?\d+\s*%?", c.strip()) for c in first)
    return table(rows, hint=True if marked else not numbers)


def parse_docx(data: bytes, name: str, options: Any) -> dict[str, Any]:
    pkg = Package(data)
    root = pkg.xml("word/document.xml")
    body = None if root is None else root.find(W + "body")
    if body is None:
        raise SourceError("parse_error", "The document has no body.")
    links, numbered, facts = pkg.links("word/document.xml"), _numbering(pkg), pkg.facts()
    styles = pkg.xml("word/styles.xml")
    names = {} if styles is None else {s.get(W + "styleId", ""): (s.find(W + "name").get(W + "val", "") if s.find(W + "name") is not None else "") for s in styles.findall(W + "style")}
    out: list[dict[str, Any] | None] = []
    items: list[tuple[int, str, bool | None]] = []
    ordered, page, title = False, 1, None

    def flush() -> None:
        if items:
            out.append(block("list", items=list(items), ordered=ordered))
            items.clear()

    def walk(parent: ET.Element) -> None:
        nonlocal ordered, page, title
        for node in parent:
            if node.tag == W + "tbl":
                flush()
                out.append(_word_table(node, links))
            elif node.tag == W + "sdt":
                inner = node.find(W + "sdtContent")
                if inner is not None:
                    walk(inner)
            elif node.tag == W + "p":
                if any(b.get(W + "type") == "page" for b in node.iter(W + "br")):
                    flush()
                    page += 1
                    if options.keep_page_breaks:
                        out.append(block("page_break", page=page))
                text = _runs(node, links).strip()
                props = node.find(W + "pPr")
                ref = None if props is None else props.find(W + "pStyle")
                style = names.get(ref.get(W + "val", ""), ref.get(W + "val", "")) if ref is not None else ""
                num = None if props is None else props.find(W + "numPr")
                low = style.lower()
                if not text:
                    continue
                if m := re.fullmatch(r"heading\s*(\d)", low):
                    flush()
                    out.append(block("heading", text.replace("**", ""), level=int(m[1])))
                elif low == "title":
                    flush()
                    if title is None and not any(b and b["type"] != "page_break" for b in out):
                        title = text.replace("**", "")
                    else:
                        out.append(block("heading", text.replace("**", ""), level=1))
                elif low == "subtitle":
                    flush()
                    out.append(block("heading", text.replace("**", ""), level=2))
                elif num is not None or low.startswith("list"):
                    level = num.find(W + "ilvl") if num is not None else None
                    ident = num.find(W + "numId") if num is not None else None
                    suffix = re.search(r"(\d)$", low)
                    depth = int(level.get(W + "val", 0)) if level is not None else (int(suffix[1]) - 1 if suffix else 0)
                    key = (ident.get(W + "val", "") if ident is not None else "", max(0, min(6, depth)))
                    kind = numbered.get(key, "number" in low)
                    if items and not depth and kind != ordered:
                        flush()
                    if not items:
                        ordered = kind
                    depth = min(depth, 6, items[-1][0] + 1 if items else 0)
                    items.append((depth, text, None))
                    continue
                elif "quote" in low:
                    flush()
                    out.append(block("quote", text))
                else:
                    flush()
                    out.append(block("paragraph", text))

    walk(body)
    flush()
    warnings: list[str] = []
    found, cut = pkg.images([t for kind, t, outside in links.values() if kind == "image" and not outside], options.limits)
    if cut:
        warnings.append(f"Only the first {len(found)} images are kept.")
    if found:
        out.append(block("heading", "Embedded images", level=2))
        out += [block("image", a["asset_id"], src=f"{options.asset_dir}/{a['filename']}") for a in found]
    return document(out, title or facts.get("title"), "heading" if title else "metadata", facts, warnings, found)


def _paragraphs(body: ET.Element) -> list[tuple[int, str]]:
    out = []
    for p in body.findall(A + "p"):
        props = p.find(A + "pPr")
        text = "".join((e.text or "") if e.tag == A + "t" else "\n" for e in p.iter() if e.tag in (A + "t", A + "br")).strip()
        if text:
            out.append((int(props.get("lvl", 0)) if props is not None else 0, text))
    return out


def _chart(root: ET.Element) -> dict[str, Any] | None:
    values = lambda node: [v.text or "" for v in node.iter(C + "v")] if node is not None else []
    series = list(root.iter(C + "ser"))
    labels = next((values(s.find(C + "cat")) for s in series if s.find(C + "cat") is not None), [])
    columns = [values(s.find(C + "val")) for s in series]
    names = [" ".join(values(s.find(C + "tx"))) or f"Series {i}" for i, s in enumerate(series, 1)]
    n = max([len(labels), *map(len, columns)], default=0)
    at = lambda x, i: x[i] if i < len(x) else ""
    return table([[at(labels, i), *(at(c, i) for c in columns)] for i in range(n)], header=["", *names], caption="Chart") if n else None


def parse_pptx(data: bytes, name: str, options: Any) -> dict[str, Any]:
    pkg = Package(data)
    root = pkg.xml("ppt/presentation.xml")
    if root is None:
        raise SourceError("parse_error", "The presentation has no main part.")
    rels, facts = pkg.links("ppt/presentation.xml"), pkg.facts()
    order = [rels[s.get(R + "id", "")][1] for s in root.iter(P + "sldId") if s.get(R + "id", "") in rels]
    warnings, out, assets = [], [], []
    if len(order) > options.limits.max_slides:
        warnings.append(f"Only the first {options.limits.max_slides} of {len(order)} slides are kept.")
    first_title = None
    for number, part in enumerate(order[: options.limits.max_slides], 1):
        slide = pkg.xml(part)
        links = pkg.links(part)
        shapes: list[tuple[int, int, int, ET.Element]] = []
        title = None
        for z, s in enumerate([] if slide is None else [e for e in slide.iter() if e.tag in (P + "sp", P + "graphicFrame", P + "pic")]):
            kind = next((e.get("type", "body") for e in s.iter(P + "ph")), "")
            if kind in ("title", "ctrTitle") and title is None and s.find(P + "txBody") is not None:
                title = " ".join(t for _, t in _paragraphs(s.find(P + "txBody"))).replace("\n", " ")
                continue
            off = next(iter(s.iter(A + "off")), None)
            shapes.append((int(off.get("y", 0)) if off is not None else 0, int(off.get("x", 0)) if off is not None else 0, z, s))
        if options.keep_page_breaks:
            out.append(block("page_break", page=number, label=None))
        first_title = first_title or title
        out.append(block("heading", title or f"Slide {number}", level=2, page=number))
        for _, _, _, s in sorted(shapes, key=lambda x: x[:3]):
            if s.tag == P + "pic":
                ref = next((b.get(R + "embed", "") for b in s.iter(A + "blip")), "")
                found, _ = pkg.images([links[ref][1]] if ref in links else [], options.limits, len(assets))
                if found and options.images != "omit":
                    assets += found
                    alt = next((e.get("descr") or e.get("name") or "" for e in s.iter(P + "cNvPr")), "")
                    out.append(block("image", alt, src=f"{options.asset_dir}/{found[0]['filename']}", page=number))
            elif (grid := next(iter(s.iter(A + "tbl")), None)) is not None:
                rows = [[" ".join(t for _, t in _paragraphs(c.find(A + "txBody"))) if c.find(A + "txBody") is not None else "" for c in r.findall(A + "tc")] for r in grid.findall(A + "tr")]
                props = grid.find(A + "tblPr")
                made = table(rows, hint=True if props is not None and props.get("firstRow") in ("1", "true") else None, page=number)
                out += [made] if made else []
            elif (ref := next((e.get(R + "id", "") for e in s.iter(C + "chart")), "")) in links:
                chart = pkg.xml(links[ref][1])
                made = None if chart is None else _chart(chart)
                out += [made] if made else []
            elif s.find(P + "txBody") is not None:
                lines = _paragraphs(s.find(P + "txBody"))
                if len(lines) == 1 and lines[0][0] == 0:
                    out.append(block("paragraph", lines[0][1], page=number))
                elif lines:
                    depth, items = 0, []
                    for level, text in lines:
                        depth = min(level, depth + 1 if items else 0)
                        items.append((depth, text, None))
                    out.append(block("list", items=items, page=number))
        if options.include_speaker_notes:
            notes = next((pkg.xml(t) for kind, t, _ in links.values() if kind == "notesSlide"), None)
            for s in [] if notes is None else notes.iter(P + "sp"):
                if any(e.get("type") == "body" for e in s.iter(P + "ph")) and s.find(P + "txBody") is not None:
                    text = "\n".join(t for _, t in _paragraphs(s.find(P + "txBody")))
                    if text:
                        out.append(block("quote", f"Notes: {text}", page=number))
    return document(out, facts.get("title") or first_title, "metadata" if facts.get("title") else "heading", facts | {"slides": len(order)}, warnings, assets)


# Built-in number formats of cells that matter for display.
_BUILT_IN = {9: "0%", 10: "0.00%", 14: "yyyy-mm-dd", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm", 19: "h:mm:ss", 20: "h:mm", 21: "h:mm:ss", 22: "yyyy-mm-dd h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss"}


def shown_number(value: float, fmt: str, epoch: dt.datetime) -> str:
    """A numeric cell as the sheet shows it: date, percent, currency, whole number or shortest decimal."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt).lower()
    if re.search(r"[dyh]|m.*s|s", bare) and "general" not in bare:
        moment = epoch + dt.timedelta(seconds=round(value * 86400))
        return moment.isoformat(sep="T", timespec="seconds") if "h" in bare or moment.time() != dt.time() else moment.date().isoformat()
    m = re.search(r"\.(0+)", fmt)
    digits = len(m[1]) if m else 0
    sign = "-" if value < 0 else ""
    if "%" in fmt:
        return f"{sign}{abs(value) * 100:.{digits}f}%"
    if symbol := re.search("[$€£¥₹]", fmt):
        return f"{sign}{symbol[0]}{abs(value):,.{digits}f}"
    if value == int(value) and abs(value) < 1e15:
        return str(int(value))
    return format(Decimal(repr(value)), "f")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def parse_xlsx(data: bytes, name: str, options: Any) -> dict[str, Any]:
    pkg = Package(data)
    book = pkg.xml("xl/workbook.xml")
    if book is None:
        raise SourceError("parse_error", "The workbook has no main part.")
    rels, facts, limits = pkg.links("xl/workbook.xml"), pkg.facts(), options.limits
    props = book.find(S + "workbookPr")
    epoch = dt.datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    strings = pkg.xml("xl/sharedStrings.xml")
    texts = [] if strings is None else ["".join(t.text or "" for t in si.iter(S + "t")) for si in strings.findall(S + "si")]
    styles = pkg.xml("xl/styles.xml")
    custom = {} if styles is None else {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in styles.iter(S + "numFmt")}
    xfs = None if styles is None else styles.find(S + "cellXfs")
    formats = [custom.get(i, _BUILT_IN.get(i, "General")) for i in ([] if xfs is None else [int(x.get("numFmtId", 0)) for x in xfs])]

    def cell(c: ET.Element) -> tuple[str, bool]:
        v, kind = c.find(S + "v"), c.get("t", "n")
        raw = "" if v is None else v.text or ""
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(S + "t")), False
        if v is None:
            return "", c.find(S + "f") is not None
        if kind == "s":
            return (texts[int(raw)] if raw.isdigit() and int(raw) < len(texts) else ""), False
        if kind == "b":
            return ("TRUE" if raw == "1" else "FALSE"), False
        if kind in ("str", "e", "d"):
            return raw, False
        style = int(c.get("s", 0))
        try:
            return shown_number(float(raw), formats[style] if style < len(formats) else "General", epoch), False
        except (ValueError, OverflowError):
            return raw, False

    out: list[dict[str, Any] | None] = []
    warnings: list[str] = []
    cells = 0
    hidden = [s.get("name", "") for s in book.iter(S + "sheet") if s.get("state", "visible") != "visible"]
    if hidden and not options.include_hidden_sheets:
        warnings.append(f"Hidden sheets were left out: {', '.join(hidden)}.")
    for sheet in book.iter(S + "sheet"):
        title = sheet.get("name", "")
        if title in hidden and not options.include_hidden_sheets or sheet.get(R + "id", "") not in rels:
            continue
        root = pkg.xml(rels[sheet.get(R + "id", "")][1])
        rows: dict[int, list[str]] = {}
        wide = uncached = False
        for r in [] if root is None else root.iter(S + "row"):
            at = int(r.get("r", len(rows) + 1))
            if len(rows) >= limits.max_sheet_rows or cells >= limits.max_table_cells:
                warnings.append(f"Sheet '{title}' was cut off after {len(rows)} rows.")
                break
            line: list[str] = []
            for k, c in enumerate(r.findall(S + "c"), 1):
                place = _column(c.get("r", "")) or k
                if place > limits.max_sheet_cols:
                    wide = True
                    break
                line += [""] * (place - len(line) - 1)
                text, missing = cell(c)
                uncached |= missing
                line.append(text)
            cells += len(line)
            rows[at] = line
        if wide:
            warnings.append(f"Sheet '{title}' has more than {limits.max_sheet_cols} columns; the rest were left out.")
        if uncached:
            warnings.append(f"Sheet '{title}' has formulas without stored results.")
        out.append(block("heading", f"Sheet: {title}", level=2))
        region: list[list[str]] = []
        for at in range(min(rows, default=1), max(rows, default=0) + 2):
            line = rows.get(at, [])
            if any(x.strip() for x in line):
                region.append(line)
            elif region:
                out += _region(region)
                region = []
    return document(out, facts.get("title"), "metadata", facts, warnings)


def _region(rows: list[list[str]]) -> list[dict[str, Any] | None]:
    if all(sum(bool(c.strip()) for c in r) <= 1 for r in rows) and len({i for r in rows for i, c in enumerate(r) if c.strip()}) == 1:
        return [block("paragraph", next(c for c in r if c.strip())) for r in rows]
    return [table(rows)]


def parse_epub(data: bytes, name: str, options: Any) -> dict[str, Any]:
    from .html import blocks, tree

    pkg = Package(data)
    box = pkg.xml("META-INF/container.xml")
    opf = next((e.get("full-path", "") for e in ([] if box is None else box.iter()) if e.tag.endswith("rootfile")), None) or next((n for n in sorted(pkg.names) if n.endswith(".opf")), None)
    root = pkg.xml(opf) if opf else None
    if root is None:
        raise SourceError("parse_error", "The book has no package file.")
    local = lambda e: e.tag.rpartition("}")[2]
    folder = posixpath.dirname(opf)
    # Dublin Core facts and their names here.
    core = {"title": "title", "creator": "author", "publisher": "publisher", "language": "language", "date": "date", "description": "description", "identifier": "identifier"}
    facts: dict[str, str] = {}
    for e in root.iter():
        if local(e) in core and (e.text or "").strip():
            facts.setdefault(core[local(e)], e.text.strip())
    manifest = {e.get("id", ""): (posixpath.normpath(posixpath.join(folder, e.get("href", ""))), e.get("media-type", "")) for e in root.iter() if local(e) == "item"}
    spine = [manifest[e.get("idref", "")][0] for e in root.iter() if local(e) == "itemref" and e.get("idref", "") in manifest]
    spine = spine or [href for href, media in manifest.values() if "html" in media]
    out: list[dict[str, Any]] = []
    chapters = 0
    for href in spine:
        if href not in pkg.names:
            continue
        page = tree(pkg.zip.read(href).decode("utf-8", "replace"))
        found = blocks(page.find(lambda n: n.tag == "body") or page)
        if not found:
            continue
        chapters += 1
        if options.keep_page_breaks:
            out.append(block("page_break", page=chapters))
        if found[0]["type"] != "heading":
            head = page.find(lambda n: n.tag == "title")
            out.append(block("heading", (head.text().strip() if head is not None else "") or f"Chapter {chapters}", level=1))
        out += found
    return document(out, facts.get("title"), "metadata", facts, [] if out else ["The book holds no readable chapter."])


