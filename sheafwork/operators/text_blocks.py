"""Plain text to blocks, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clean_folded, let, looks_like_heading, strip

BULLET = "^[ \\t]*[-*•·‣▪◦][ \\t]+"
ORDERED = "^[ \\t]*[0-9]+[.)][ \\t]+"
SETEXT = "^[ \\t]*(={3,}|-{3,})[ \\t]*$"

TEXT_BLOCK = "struct<kind:string,level:int,text:string,items:array<string>>"


def classify(paragraph: Column, detect_headings: bool = True) -> Column:
    """One run of lines without a blank one, as (kind, level, text, items)."""
    none = F.array().cast("array<string>")

    def made(kind: str, level: Column | None, text: Column | None, items: Column = none) -> Column:
        null = F.lit(None)
        return F.struct(F.lit(kind).alias("kind"), (level if level is not None else null).cast("int").alias("level"), (text if text is not None else null).cast("string").alias("text"), items.alias("items")).cast(TEXT_BLOCK)

    def of(lines: Column) -> Column:
        first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
        stripped = lambda p: F.transform(lines, lambda x: strip(F.regexp_replace(x, p, "")))
        out = F.when(F.size(lines) == 0, F.lit(None).cast(TEXT_BLOCK))
        out = out.when(F.forall(lines, lambda x: x.rlike(BULLET)), made("list", None, None, stripped(BULLET)))
        out = out.when(F.forall(lines, lambda x: x.rlike(ORDERED)), made("ordered_list", None, None, stripped(ORDERED)))
        out = out.when((F.size(lines) == 2) & second.rlike(SETEXT), made("heading", F.when(strip(second).startswith("="), 1).otherwise(2), strip(first)))
        if detect_headings:
            out = out.when((F.size(lines) == 1) & looks_like_heading(first), made("heading", F.lit(2), strip(first)))
        return out.otherwise(made("paragraph", None, strip(F.array_join(lines, " "))))

    return let(F.filter(F.transform(F.split(paragraph, "\n"), lambda x: F.rtrim(x, F.lit(" \t\r\f\x0b"))), lambda x: strip(x) != ""), of)


def text_blocks(text: Column, detect_headings: bool = True) -> Column:
    """Array of (kind, level, text, items) of a whole text, in order."""
    paragraphs = F.split(text, "\\n[ \\t\\r\\f\\x0B]*(\\n[ \\t\\r\\f\\x0B]*)*\\n")
    return F.filter(F.transform(paragraphs, lambda p: classify(p, detect_headings)), lambda b: b.isNotNull())


def as_blocks(found: Column) -> Column:
    """The same as block structs."""
    from ..schema import BLOCK_STRUCT

    def one(b: Column) -> Column:
        null = F.lit(None)
        listed = b["kind"].isin("list", "ordered_list")
        items = F.when(listed, F.transform(b["items"], lambda t: F.struct(F.lit(0).alias("depth"), t.alias("text"), null.cast("boolean").alias("checked"))))
        return F.struct(
            F.when(listed, "list").otherwise(b["kind"]), b["text"], b["level"], null.cast("int"), null.cast("string"), null.cast("string"), F.when(listed, b["kind"] == "ordered_list"),
            items, null.cast("array<string>"), null.cast("array<array<string>>"), null.cast("string"), null.cast("array<struct<k:string,v:string>>"), null.cast("string"),
        ).cast(BLOCK_STRUCT)

    return F.transform(found, one)


def expand(blocks: Column, detect_headings: bool = True) -> Column:
    """The blocks with those of kind ``plain``, whole texts in NFKC, cut into headings, lists and paragraphs.

    Their headings go ``level`` levels deeper. In a nested text with a title (``ordered``)
    a leading heading stands right under the heading of the place it is nested in.
    """

    def one(b: Column) -> Column:
        down = F.coalesce(b["level"], F.lit(0))
        found = as_blocks(text_blocks(clean_folded(b["text"]), detect_headings))
        level = lambda x, i: F.when(b["ordered"] & (i == 0) & (down > 0), down + 1).otherwise(x["level"] + down)
        placed = F.transform(found, lambda x, i: F.when(x["type"] == "heading", x.withField("level", F.least(F.lit(6), level(x, i)))).otherwise(x))
        return F.when(b["type"] == "plain", placed).otherwise(F.array(b))

    return F.when(F.exists(blocks, lambda b: b["type"] == "plain"), F.flatten(F.transform(blocks, one))).otherwise(blocks)


def titled(blocks: Column) -> Column:
    """Whether the blocks, not expanded yet, begin with a whole text whose first heading is the document's title."""
    first = F.get(blocks, F.lit(0))
    return F.coalesce((first["type"] == "plain") & first["ordered"] & (F.coalesce(first["level"], F.lit(0)) == 0), F.lit(False))


def lift_title(found: Column, kind: str = "kind") -> Column:
    """(title, rest): a leading heading becomes the title and leaves the blocks. kind: the field that names what a block is."""
    first = F.get(found, F.lit(0))
    lifted = F.coalesce(first[kind] == "heading", F.lit(False))
    return F.struct(F.when(lifted, first["text"]).alias("title"), F.when(lifted, F.slice(found, 2, 1 << 30)).otherwise(found).alias("rest"))
