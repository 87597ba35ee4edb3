"""Facts of HTML pages that expressions can read without a parser; the parser itself is a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import inline_safe

# Elements whose content is not the page's text.
CHROME = ("script", "style", "noscript", "template", "svg", "canvas", "iframe", "nav", "header", "footer", "aside", "form", "button", "select")
# References decoded, the ampersand last.
_NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def decode_references(c: Column) -> Column:
    for old, new in _NAMED:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def strip_tags(c: Column) -> Column:
    return inline_safe(decode_references(F.regexp_replace(c, "<[^>]*>", " ")))


def title(html: Column) -> Column:
    return strip_tags(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def drop_chrome(html: Column) -> Column:
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in CHROME:
        out = F.regexp_replace(out, f"(?is)<{tag}( [^>]*)?>.*?</{tag}>", "")
    return out


def elements(html: Column, tag: str) -> Column:
    """Texts of the elements of a tag that have an end tag."""
    return F.transform(F.regexp_extract_all(html, F.lit(f"(?is)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1)), strip_tags)


def links(html: Column) -> Column:
    """Array of (href, text) of anchors, without script targets."""
    hrefs = F.regexp_extract_all(html, F.lit('(?is)<a [^>]*?href="([^"]*)"[^>]*>.*?</a>'), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit('(?is)<a [^>]*?href="[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    both = F.zip_with(hrefs, texts, lambda h, t: F.struct(h.alias("href"), strip_tags(t).alias("text")))
    return F.filter(both, lambda x: ~F.lower(x["href"]).startswith("javascript:"))


def meta(html: Column, name: str) -> Column:
    return decode_references(F.regexp_extract(html, f'(?is)<meta [^>]*?(?:name|property)="{name}"[^>]*?content="([^"]*)"', 1))


def language_class(attributes: Column) -> Column:
    return F.regexp_extract(attributes, "(?:language|lang)-([A-Za-z0-9_+-]+)", 1)
