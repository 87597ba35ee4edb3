"""Page layout inference over a document's lines.

The rules are column functions of one document's lines, an array of (page, line_no, y,
size, bold, text) in reading order, so a document never leaves its row and nothing is
shuffled. ``by_document`` gathers a relation of lines into such rows. Functions that
relate lines to tables of contents, boxes and tables work on relations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import generalise, is_page_number, let, looks_like_heading, normal_line, strip
from ..schema import BLOCK_STRUCT, ITEM

ABOVE_BODY = 1.12
BULLET = "^[ \\t]*[-*•·‣▪◦●○][ \\t]+"
NUMBERED = "^[ \\t]*[0-9]{1,2}[.)][ \\t]+"
SENTENCE_END = "[.!?:;\"”]$"
#: Running lines are looked for in so many lines at either end of a page, up to so many characters.
AT_ENDS, LONGEST_RUNNING = 2, 120


def by_document(lines: DataFrame) -> DataFrame:
    """(doc_id, lines) of a relation (doc_id, page, line_no, y, size, bold, text)."""
    line = F.struct(F.col("page").cast("int").alias("page"), F.col("line_no").cast("int").alias("line_no"), F.col("y").cast("double").alias("y"), F.col("size").cast("double").alias("size"), "bold", "text")
    return lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))


def _runs(ordered: Column) -> Column:
    """(value, n) of the runs of equal values in a sorted array."""

    def of(xs: Column) -> Column:
        starts = F.filter(F.transform(xs, lambda x, i: i), lambda i: (i == 0) | (F.get(xs, i) != F.get(xs, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(xs, i).alias("value"), (F.coalesce(F.get(at, k + 1), F.size(xs)) - i).alias("n"))))

    return let(ordered, of)


def body_size(lines: Column) -> Column:
    """The font size that most characters have, the one seen first at a tie."""
    weight = lambda xs, s: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.when(x["size"] == s, F.greatest(F.lit(1), F.length(x["text"]))).otherwise(0))
    sizes = lambda xs: F.array_distinct(F.transform(xs, lambda x: x["size"]))
    return let(lines, lambda xs: F.array_max(F.transform(sizes(xs), lambda s, i: F.struct(weight(xs, s).alias("w"), (-i).alias("first"), s.alias("size"))))["size"])


def heading_sizes(lines: Column, body: Column) -> Column:
    """The four largest sizes above the body's, the largest first."""
    sizes = F.filter(F.array_distinct(F.transform(lines, lambda x: x["size"])), lambda s: (body > 0) & (s > body * ABOVE_BODY))
    return F.slice(F.sort_array(sizes, asc=False), 1, 4)


def running_furniture(lines: Column) -> Column:
    """(key, pages) of the lines that stand in the first or last two of most pages, by key."""

    def found(xs: Column) -> Column:
        page = lambda i: F.when((i >= 0) & (i < F.size(xs)), F.get(xs, i)["page"])
        here = lambda x, i: ~F.coalesce(page(i - AT_ENDS) == x["page"], F.lit(False)) | ~F.coalesce(page(i + AT_ENDS) == x["page"], F.lit(False))
        ends = F.transform(xs, lambda x, i: F.when(here(x, i), F.struct(generalise(x["text"]).alias("key"), x["page"].alias("page"))))
        ends = F.filter(ends, lambda e: e.isNotNull() & (e["key"] != "") & (F.length(e["key"]) < LONGEST_RUNNING))
        seen = _runs(F.sort_array(F.transform(F.array_distinct(ends), lambda e: e["key"])))
        pages = F.array_max(F.transform(xs, lambda x: x["page"]))
        needed = F.when(pages < 4, pages).otherwise(F.greatest(F.lit(3), F.floor(pages * 0.6)))
        kept = let(needed, lambda least: F.filter(seen, lambda r: r["n"] >= least))
        return F.when(pages >= 2, F.transform(kept, lambda r: F.struct(r["value"].alias("key"), r["n"].cast("long").alias("pages")))).otherwise(F.array().cast("array<struct<key:string,pages:bigint>>"))

    return let(lines, found)


def without_furniture(lines: Column, keys: Column) -> Column:
    """Lines without blank ones, bare page numbers and those of the keys."""
    return let(keys, lambda ks: F.filter(lines, lambda x: (strip(x["text"]) != "") & ~is_page_number(x["text"]) & ~F.array_contains(ks, generalise(x["text"]))))


def level_of(line: Column, body: Column, sizes: Column, outline_level: Column, detect_headings: bool = True) -> Column:
    """Heading level of a line: by the outline, then the font's rank in heading_sizes, then bold short lines; null if it is none."""
    out = F.when(outline_level.isNotNull(), outline_level.cast("int"))
    if detect_headings:
        rank = F.array_position(sizes, line["size"]).cast("int")
        out = out.when(rank > 0, rank).when(line["bold"] & (line["size"] >= body) & looks_like_heading(line["text"], 10), F.lit(3))
    return out


def levelled(lines: Column, body: Column, sizes: Column, outline: Column | None = None, detect_headings: bool = True) -> Column:
    """(page, line_no, y, text, level) of each line. outline: map of "page title", the title folded, to level."""

    def one(x: Column, body: Column, sizes: Column, outline: Column | None) -> Column:
        known = F.lit(None) if outline is None else F.try_element_at(outline, F.concat_ws(" ", x["page"].cast("string"), normal_line(x["text"])))
        return F.struct(x["page"].alias("page"), x["line_no"].alias("line_no"), x["y"].alias("y"), x["text"].alias("text"), level_of(x, body, sizes, known, detect_headings).alias("level"))

    # Bound, so that no line computes them again.
    facts = F.struct(body.alias("body"), sizes.alias("sizes"), *([] if outline is None else [outline.alias("outline")]))
    return let(facts, lambda f: F.transform(lines, lambda x: one(x, f["body"], f["sizes"], None if outline is None else f["outline"])))


def reflow(lines: Column) -> Column:
    """(page, line_no, y, kind, level, texts) of runs of lines that make one paragraph, list or heading.

    lines: by ``levelled``. A paragraph ends with a sentence's end, a heading, a list or
    the page; line_no and y are those of the first line.
    """
    bullet = lambda t: t.rlike(BULLET)
    number = lambda t: t.rlike(NUMBERED) & ~looks_like_heading(t)
    kind = lambda x: F.when(bullet(x["text"]), "list").when(number(x["text"]), "ordered_list").when(x["level"].isNotNull(), "heading").otherwise("paragraph")
    bare = lambda t, k: F.when(k == "list", strip(F.regexp_replace(t, BULLET, ""))).when(k == "ordered_list", strip(F.regexp_replace(t, NUMBERED, ""))).otherwise(t)

    def grouped(xs: Column) -> Column:
        def begins(i: Column) -> Column:
            x, before = F.get(xs, i), F.get(xs, i - 1)
            apart = (before["page"] != x["page"]) | (before["kind"] != x["kind"]) | (x["kind"] == "heading")
            return (i == 0) | apart | ((x["kind"] == "paragraph") & before["text"].rlike(SENTENCE_END))

        starts = F.filter(F.transform(xs, lambda x, i: i), begins)

        def made(at: Column) -> Column:
            def group(i: Column, k: Column) -> Column:
                x = F.get(xs, i)
                run = F.slice(xs, i + 1, F.coalesce(F.get(at, k + 1), F.size(xs)) - i)
                level = F.when(x["kind"] == "heading", x["level"])
                return F.struct(x["page"].alias("page"), x["line_no"].alias("line_no"), x["y"].alias("y"), x["kind"].alias("kind"), level.alias("level"), F.transform(run, lambda r: bare(r["text"], r["kind"])).alias("texts"))

            return F.transform(at, group)

        return let(starts, made)

    return let(F.transform(lines, lambda x: x.withField("kind", kind(x))), grouped)


def as_blocks(layout: Column, detect_headings: bool = True, page_breaks: bool = True) -> Column:
    """(blocks, removed, empty) of ``schema.LAYOUT``: blocks in reading order, the removed running lines, and the number of pages without text or table.

    A table stands before the run of lines that begins with, or after, the first line
    that is not above it.
    """
    null = lambda t: F.lit(None).cast(t)

    def block(kind: Column, text: Column, level: Column, page: Column, ordered: Column, items: Column) -> Column:
        return F.struct(
            kind.alias("type"), text.alias("text"), level.cast("int").alias("level"), page.alias("page"), null("string").alias("label"), null("string").alias("lang"), ordered.alias("ordered"), items.alias("items"),
            null("array<string>").alias("header"), null("array<array<string>>").alias("rows"), null("string").alias("caption"), null("array<struct<k:string,v:string>>").alias("kv"), null("string").alias("src"),
        ).cast(BLOCK_STRUCT)

    def of_group(g: Column) -> Column:
        listed = g["kind"].isin("list", "ordered_list")
        items = F.when(listed, F.transform(g["texts"], lambda t: F.struct(F.lit(0).alias("depth"), t.alias("text"), null("boolean").alias("checked")))).cast(f"array<{ITEM}>")
        return block(F.when(listed, "list").otherwise(g["kind"]), F.when(~listed, F.array_join(g["texts"], " ")), g["level"], g["page"], F.when(listed, g["kind"] == "ordered_list"), items)

    def build(lines: Column, keys: Column) -> Column:
        outline = F.map_from_entries(F.transform(layout["outline"], lambda e: F.struct(F.concat_ws(" ", e["page"].cast("string"), e["title"]).alias("k"), e["level"].alias("v"))))
        # Lines are cut into runs where a table comes between them, so a run has one place.
        before = lambda x: F.size(F.filter(layout["tables"], lambda t: (t["page"] == x["page"]) & (t["y"] <= x["y"])))
        place = lambda page, at, rank, b: F.struct(page.alias("page"), at.cast("double").alias("at"), rank.alias("rank"), b.alias("b"))
        body = body_size(layout["lines"])
        marked = let(body, lambda size: let(heading_sizes(layout["lines"], size), lambda sizes: levelled(lines, size, sizes, outline, detect_headings)))
        split = F.transform(F.sequence(F.lit(0), F.size(layout["tables"])), lambda k: F.filter(marked, lambda x: before(x) == k))
        groups = let(F.flatten(F.transform(split, reflow)), lambda gs: F.transform(gs, lambda g: place(g["page"], g["line_no"], F.lit(1), of_group(g))))
        first = lambda t: F.array_min(F.transform(F.filter(lines, lambda x: (x["page"] == t["page"]) & (x["y"] >= t["y"])), lambda x: x["line_no"]))
        tables = F.transform(layout["tables"], lambda t: place(t["page"], F.coalesce(first(t), F.lit(1 << 30)), F.lit(0), t["block"]))
        pages = F.sequence(F.lit(1), layout["number"])
        none = F.array().cast(f"array<struct<page:int,at:double,rank:int,b:{BLOCK_STRUCT}>>")
        breaks = F.transform(pages, lambda p: place(p, F.lit(-1), F.lit(0), block(F.lit("page_break"), null("string"), null("int"), p, null("boolean"), null(f"array<{ITEM}>"))))
        placed = F.concat(F.when(F.lit(page_breaks) & (layout["number"] > 0), breaks).otherwise(none), tables, groups)
        ordered = F.array_sort(placed, lambda a, b: F.when(_key(a) < _key(b), -1).when(_key(a) > _key(b), 1).otherwise(0))
        used = F.array_distinct(F.concat(F.transform(lines, lambda x: x["page"]), F.transform(layout["tables"], lambda t: t["page"])))
        return F.struct(F.transform(ordered, lambda x: x["b"]).alias("blocks"), F.filter(F.array_sort(keys), lambda k: F.regexp_replace(k, "[# ]", "") != "").alias("removed"), (layout["number"] - F.size(used)).alias("empty"))

    keys = F.transform(running_furniture(layout["lines"]), lambda r: r["key"])
    return let(keys, lambda ks: let(without_furniture(layout["lines"], ks), lambda lines: build(lines, ks)))


def _key(x: Column) -> Column:
    return F.struct(x["page"], x["at"], x["rank"])




def outline_levels(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """Adds ``outline_level`` by the document's own table of contents (doc_id, page, seq, level, title); the last entry of a page and title wins."""
    keyed = outline.select("doc_id", "page", "seq", "level", normal_line(F.col("title")).alias("norm")).where("norm <> ''")
    last = keyed.groupBy("doc_id", "page", "norm").agg(F.max_by("level", "seq").alias("outline_level"))
    clamped = last.withColumn("outline_level", F.greatest(F.lit(1), F.least(F.lit(6), F.col("outline_level"))))
    return lines.withColumn("norm", normal_line(F.col("text"))).join(clamped, ["doc_id", "page", "norm"], "left").drop("norm")


def outside_boxes(lines: DataFrame, boxes: DataFrame, slack: float = 2.0) -> DataFrame:
    """Lines whose centre lies in no table box of their page. lines: x0, y0, x1, y1; boxes: doc_id, page, x0, y0, x1, y1."""
    l, b = lines.alias("l"), boxes.alias("b")
    cx, cy = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    inside = cx.between(F.col("b.x0") - slack, F.col("b.x1") + slack) & cy.between(F.col("b.y0") - slack, F.col("b.y1") + slack)
    return l.join(b, (F.col("l.doc_id") == F.col("b.doc_id")) & (F.col("l.page") == F.col("b.page")) & inside, "left_anti")


def interleave_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, seq, kind, ref): tables before the first line that is not above them."""
    rows = tables.select("doc_id", "page", "y", F.lit(0).alias("rank"), F.lit("table").alias("kind"), F.col("table_no").cast("long").alias("ref"))
    rows = rows.unionByName(lines.select("doc_id", "page", "y", F.lit(1).alias("rank"), F.lit("line").alias("kind"), F.col("line_no").cast("long").alias("ref")))
    w = Window.partitionBy("doc_id", "page").orderBy("y", "rank", "ref")
    return rows.select("doc_id", "page", F.row_number().over(w).cast("long").alias("seq"), "kind", "ref")


def scanned(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, empty_pages, looks_scanned) from the kept lines and all pages (doc_id, page)."""
    full = lines.select("doc_id", "page").distinct().withColumn("full", F.lit(1))
    per = pages.join(full, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.count(F.when(F.col("full").isNull(), 1)).alias("empty_pages"), F.count("*").alias("pages"))
    return per.select("doc_id", "empty_pages", ((F.col("empty_pages") > 0) & (F.col("empty_pages") >= F.greatest(F.lit(1), F.floor(F.col("pages") / 2)))).alias("looks_scanned"))


def islands(rows: DataFrame, key: list[str], order: str, blank: str) -> DataFrame:
    """Adds ``region``: runs of rows between blank ones, counted from 1; blank rows go."""
    w = Window.partitionBy(*key).orderBy(order)
    starts = ~F.col(blank) & F.coalesce(F.lag(blank).over(w), F.lit(True))
    return rows.withColumn("region", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).where(~F.col(blank))
