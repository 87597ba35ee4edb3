"""Blocks to Markdown: one expression per block type, documents by an ordered join of their blocks."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import escape_block_start, inline_safe, let, longest_backtick_run, strip
from ..options import ConvertOptions

#: Opens the comment that marks a page in the output.
ANCHOR = "sheaf:page"


def heading(text: Column, level: Column, offset: int = 0) -> Column:
    n = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1)) + offset))
    return F.concat(F.repeat(F.lit("#"), n.cast("int")), F.lit(" "), inline_safe(text))


def quote(text: Column) -> Column:
    lines = F.split(escape_block_start(strip(text)), "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")


def code(text: Column, lang: Column) -> Column:
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_backtick_run(text) + 1).cast("int"))
    return F.concat(fence, F.coalesce(lang, F.lit("")), F.lit("\n"), text, F.lit("\n"), fence)


def image(alt: Column, src: Column, mode: str) -> Column:
    alt, src = F.replace(F.coalesce(alt, F.lit("")), F.lit("]"), F.lit("\\]")), F.coalesce(src, F.lit(""))
    if mode == "omit":
        return F.lit("")
    if mode == "placeholder":
        return F.concat(F.lit("`[image: "), F.when(alt != "", alt).otherwise(src), F.lit("]`"))
    return F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")"))


def page_break(page: Column, label: Column, options: ConvertOptions) -> Column:
    if not options.keep_page_breaks:
        return F.lit("")
    if not options.page_anchors:
        return F.lit("---")
    mark = F.when(page.isNotNull(), F.concat(F.lit(f"<!-- {ANCHOR} "), page.cast("string"), F.lit(" -->"))).otherwise(F.lit(f"<!-- {ANCHOR} -->"))
    return F.when(F.coalesce(label, F.lit("")) != "", F.concat(mark, F.lit("\n\n**"), label, F.lit("**"))).otherwise(mark)


def key_values(kv: Column) -> Column:
    return F.array_join(F.transform(kv, lambda p: F.concat(F.lit("- **"), inline_safe(p["k"]), F.lit(":** "), inline_safe(p["v"]))), "\n")


def list_lines(items: Column, ordered: Column) -> Column:
    """Items in reading order with their depth; the numbers of an ordered list count its outermost items."""

    def line(x: Column, i: Column, outer: Column) -> Column:
        number = F.array_position(outer, i)
        mark = F.when(F.coalesce(ordered, F.lit(False)) & (x["depth"] == 0), F.concat(number.cast("string"), F.lit("."))).otherwise(F.lit("-"))
        box = F.when(x["checked"].isNull(), "").when(x["checked"], "[x] ").otherwise("[ ] ")
        return F.rtrim(F.concat(F.repeat(F.lit("  "), x["depth"]), mark, F.lit(" "), box, strip(F.replace(x["text"], F.lit("\n"), F.lit(" ")))))

    outer = F.filter(F.transform(items, lambda x, i: F.when(x["depth"] == 0, i)), lambda i: i.isNotNull())
    return F.array_join(let(outer, lambda at: F.transform(items, lambda x, i: line(x, i, at))), "\n")


def _wrapped(text: Column, width: int) -> Column:
    @F.pandas_udf("string")
    def wrap(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "\n".join(textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False)) if len(x) > width else x, na_action="ignore")

    return wrap(text)


def block(b: Column, options: ConvertOptions | None = None) -> Column:
    """The Markdown of a block struct; empty if it renders to nothing."""
    o = options or ConvertOptions()
    text = F.coalesce(b["text"], F.lit(""))
    if o.table_format == "csv":
        table = tables.csv_table(b["header"], b["rows"])
    elif o.table_format == "html":
        table = tables.html_table(b["header"], b["rows"])
    else:
        table = tables.pipe_table(b["header"], b["rows"], F.coalesce(b["caption"], F.lit("")))
    kind = b["type"]
    paragraph = strip(text)
    if o.wrap_width:
        paragraph = _wrapped(paragraph, o.wrap_width)
    return F.coalesce(
        F.when(kind == "heading", heading(text, b["level"], o.heading_offset))
        .when(kind == "paragraph", escape_block_start(paragraph))
        .when(kind == "quote", quote(text))
        .when(kind == "code", code(text, b["lang"]))
        .when(kind == "rule", F.lit("---"))
        .when(kind == "raw", strip(text))
        .when(kind == "image", image(text, b["src"], o.images))
        .when(kind == "page_break", page_break(b["page"], b["label"], o))
        .when(kind == "key_values", key_values(b["kv"]))
        .when(kind == "list", list_lines(b["items"], b["ordered"]))
        .when(kind == "table", table),
        F.lit(""),
    )


def title_repeated(blocks: Column, title: Column) -> Column:
    """Whether the first block that is no page break is a heading that says the title."""
    first = F.get(F.filter(blocks, lambda b: b["type"] != "page_break"), F.lit(0))
    return F.coalesce((first["type"] == "heading") & (F.lower(inline_safe(first["text"])) == F.lower(inline_safe(title))), F.lit(False))


def markdown(documents: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """Adds ``markdown`` to rows of (title, passthrough, blocks, frontmatter if there is one)."""
    o = options or ConvertOptions()
    parts = F.transform("blocks", lambda b: block(b, o)) if not o.wrap_width else F.col("rendered")
    if o.wrap_width:  # a Python function can't stand inside a transform
        documents = _rendered_rows(documents, o)
    title = F.coalesce(F.col("title"), F.lit(""))
    show = (title != "") & ~F.coalesce(F.col("passthrough"), F.lit(False)) & ~title_repeated(F.col("blocks"), title)
    head = F.when(show, F.array(F.concat(F.lit("# "), inline_safe(title)))).otherwise(F.array().cast("array<string>"))
    front = F.array(F.coalesce(F.col("frontmatter"), F.lit(""))) if o.frontmatter and "frontmatter" in documents.columns else F.array().cast("array<string>")
    body = strip(F.array_join(F.filter(F.concat(front, head, parts), lambda x: x != ""), "\n\n"))
    return documents.withColumn("markdown", F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))).drop(*(["rendered"] if o.wrap_width else []))


def _rendered_rows(documents: DataFrame, o: ConvertOptions) -> DataFrame:
    keyed = documents.withColumn("render_key", F.monotonically_increasing_id())
    rows = keyed.select("render_key", F.posexplode("blocks").alias("pos", "b"))
    lines = rows.select("render_key", "pos", block(F.col("b"), o).alias("md")).groupBy("render_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "md"))), lambda x: x["md"]).alias("rendered"))
    return keyed.join(lines, "render_key", "left").withColumn("rendered", F.coalesce("rendered", F.array().cast("array<string>"))).drop("render_key")
