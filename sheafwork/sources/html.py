"""HTML and XML: a forgiving element tree from the standard tokenizer, walked into blocks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from typing import Any

from ..operators.html_facts import CHROME
from .model import SourceError, block, document, table
from .plain import clean, decode

DEPTH, LIST_DEPTH, XML_DEPTH = 40, 8, 12
# Elements without an end tag; elements that an opening of the same group closes.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_BOUNDARY = {"table", "ul", "ol", "dl", "td", "th", "div", "section", "article", "main", "body", "html"}
_BLOCKY = {
    "address", "article", "aside", "blockquote", "body", "dd", "details", "dl", "div", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# Inline marks; page facts by attribute and value.
_MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_", "del": "~~", "s": "~~", "strike": "~~"}
_META = (("name", "description", "description"), ("name", "author", "author"), ("name", "keywords", "keywords"), ("property", "og:title", "og_title"), ("property", "og:site_name", "site_name"), ("property", "og:url", "canonical_url"), ("property", "article:published_time", "published"))


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def find(self, test: Any) -> Node | None:
        stack = [self]
        while stack:
            n = stack.pop()
            if n is not self and test(n):
                return n
            stack.extend(reversed(n.elements()))
        return None

    def all(self, tag: str) -> list[Node]:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n is not self and n.tag == tag:
                out.append(n)
            stack.extend(reversed(n.elements()))
        return out

    def text(self) -> str:
        out: list[str] = []
        stack: list[Any] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                stack.extend(reversed(n.children))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = _CLOSES.get(tag, {"p"} if tag in _BLOCKY else set())
        close = 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in ends:
                close = k
            elif self.open[k].tag in _BOUNDARY:
                break
        if close:
            del self.open[close:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(text: str) -> Node:
    t = _Tree()
    t.feed(text)
    t.close()
    return t.root


def _prune(node: Node) -> None:
    stack = [node]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or c.tag not in CHROME]
        stack.extend(n.elements())


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def inline(node: Node | str, depth: int = 0) -> str:
    """Inline Markdown of an element's content."""
    if isinstance(node, str):
        return _squeeze(node)
    if depth > DEPTH:
        return _squeeze(node.text())
    if node.tag == "br":
        return "\n"
    if node.tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})" if node.attrs.get("src") else ""
    body = "".join(inline(c, depth + 1) for c in node.children)
    bare = body.strip()
    if not bare:
        return body
    lead, trail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
    if node.tag == "a":
        href = node.attrs.get("href", "").strip()
        return f"{lead}[{bare}]({href}){trail}" if href and not href.lower().startswith("javascript:") else body
    if node.tag == "code":
        return f"{lead}`{bare}`{trail}"
    mark = _MARKS.get(node.tag, "")
    return f"{lead}{mark}{bare}{mark}{trail}"


def _tidy(text: str) -> str:
    return "\n".join(x.strip() for x in re.sub(r"[ \t]{2,}", " ", text).strip().split("\n"))


def _items(node: Node, depth: int = 0) -> list[tuple[int, str, bool | None]]:
    out: list[tuple[int, str, bool | None]] = []
    if depth >= LIST_DEPTH:
        return out
    for li in node.elements():
        if li.tag != "li":
            continue
        nested = [c for c in li.elements() if c.tag in ("ul", "ol")]
        box = li.find(lambda n: n.tag == "input" and n.attrs.get("type") == "checkbox")
        text = _tidy("".join(inline(c) for c in li.children if not (isinstance(c, Node) and (c in nested or c.tag == "input")))).replace("\n", " ")
        out.append((depth, text, ("checked" in box.attrs) if box is not None else None))
        for sub in nested:
            out += _items(sub, depth + 1)
    return out


def _rows(node: Node) -> list[Node]:
    """Direct rows of a table, in its sections or not; rows of nested tables stay there."""
    out = []
    for c in node.elements():
        if c.tag == "tr":
            out.append(c)
        elif c.tag in ("thead", "tbody", "tfoot"):
            out += [r for r in c.elements() if r.tag == "tr"]
    return out


def _table(node: Node) -> dict[str, Any] | None:
    rows = _rows(node)
    cells = [[_tidy(inline(c)).replace("\n", " ") for c in r.elements() if c.tag in ("td", "th")] for r in rows]
    kinds = [[c.tag for c in r.elements() if c.tag in ("td", "th")] for r in rows]
    head = next((c for c in node.elements() if c.tag == "thead"), None)
    marked = bool(rows) and ((head is not None and rows[0] in head.elements()) or (bool(kinds[0]) and set(kinds[0]) == {"th"}))
    caption = next((_tidy(c.text()) for c in node.elements() if c.tag == "caption"), None)
    return table(cells, hint=True if marked else None, caption=caption)


def language(node: Node) -> str:
    for n in [node, *node.elements()]:
        if m := re.search(r"(?:^|\s)(?:language|lang)-([\w+-]+)", n.attrs.get("class", "")):
            return m[1]
    return ""


def blocks(node: Node, depth: int = 0) -> list[dict[str, Any]]:
    """Blocks of an element's children; runs of inline content between block elements are one paragraph."""
    out: list[dict[str, Any] | None] = []
    run: list[str] = []

    def flush() -> None:
        text = _tidy("".join(run))
        run.clear()
        if text:
            out.append(block("paragraph", text))

    for c in node.children:
        if isinstance(c, str) or (c.tag not in _BLOCKY and c.tag != "img" and not _holds_blocks(c)):
            run.append(inline(c))
            continue
        flush()
        if depth > DEPTH:
            out.append(block("paragraph", _squeeze(c.text())))
        elif re.fullmatch(r"h[1-6]", c.tag):
            if text := _tidy(inline_children(c)).replace("\n", " "):
                out.append(block("heading", text, level=int(c.tag[1])))
        elif c.tag in ("ul", "ol"):
            if items := _items(c):
                out.append(block("list", items=items, ordered=c.tag == "ol"))
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag == "pre":
            out.append(block("code", c.text().strip("\n").rstrip(), lang=language(c)))
        elif c.tag == "blockquote":
            if text := _tidy(inline_children(c)):
                out.append(block("quote", text))
        elif c.tag == "hr":
            out.append(block("rule"))
        elif c.tag == "img":
            if c.attrs.get("src"):
                out.append(block("image", c.attrs.get("alt", ""), src=c.attrs["src"]))
        elif c.tag == "dl":
            names = [x for x in c.elements() if x.tag in ("dt", "dd")]
            pairs = [(_tidy(inline_children(a)), _tidy(inline_children(b))) for a, b in zip(names, names[1:], strict=False) if a.tag == "dt" and b.tag == "dd"]
            if pairs:
                out.append(block("key_values", kv=pairs))
        elif c.tag == "figcaption":
            if text := _tidy(inline_children(c)):
                out.append(block("paragraph", f"*{text}*"))
        else:
            out += blocks(c, depth + 1)
    flush()
    return [b for b in out if b]


def _holds_blocks(node: Node) -> bool:
    return node.find(lambda n: n.tag in _BLOCKY) is not None


def inline_children(node: Node) -> str:
    return "".join(inline(c) for c in node.children)


def _main(root: Node) -> Node:
    has = lambda key, value: lambda n: value in n.attrs.get(key, "").split()
    # Where the main content is looked for, in order.
    tests = [lambda n: n.tag == "main", lambda n: n.tag == "article", has("role", "main"), has("id", "content"), has("id", "main"), has("class", "content"), has("class", "post-body")]
    for test in tests:
        found = root.find(test)
        if found is not None and len(found.text().strip()) > 200:
            return found
    return root.find(lambda n: n.tag == "body") or root


def parse_html(data: bytes, name: str, options: Any) -> dict[str, Any]:
    root = tree(decode(data))
    title = root.find(lambda n: n.tag == "title")
    facts = {}
    for node in root.all("meta"):
        for key, value, out in _META:
            if node.attrs.get(key, "").lower() == value and node.attrs.get("content"):
                facts.setdefault(out, node.attrs["content"].strip())
    name_of = _squeeze(title.text()).strip() if title is not None else ""
    _prune(root)
    found = blocks(_main(root))
    if not name_of and found and found[0]["type"] == "heading":
        return document(found, found[0]["text"], "heading", facts)
    return document(found, name_of, "title", facts, [] if found else ["The page has no text."])


def parse_xml(data: bytes, name: str, options: Any) -> dict[str, Any]:
    text = decode(data)
    if re.search(r"<!(DOCTYPE[^>]*\[|ENTITY)", text):
        raise SourceError("parse_error", "XML with its own entities is not read.")
    try:
        root = ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
    except ET.ParseError:
        return document([block("code", text.rstrip(), lang="xml")], warnings=["The XML is not well-formed; kept as it is."])
    out: list[dict[str, Any]] = []
    _walk(root, 1, out)
    return document(out, _local(root.tag), "root", {"root": _local(root.tag)})


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _walk(node: ET.Element, level: int, out: list[dict[str, Any]]) -> None:
    facts = [(f"@{_local(k)}", v) for k, v in node.attrib.items()]
    own = clean(node.text or "")
    if len(node) == 0:
        pairs = facts + [(_local(node.tag), own)]
        if out and out[-1]["type"] == "key_values" and out[-1]["level"] == level:
            out[-1]["kv"] += [{"k": k, "v": v} for k, v in pairs]
        else:
            out.append(block("key_values", kv=pairs, level=level))
        return
    out.append(block("heading", _local(node.tag), level=min(level, 6)))
    if facts:
        out.append(block("key_values", kv=facts, level=level + 1))
    if own:
        out.append(block("paragraph", own))
    if level >= XML_DEPTH:
        out.append(block("paragraph", _squeeze(" ".join(node.itertext()))))
        return
    for child in node:
        _walk(child, level + 1, out)
