"""Counts of recovered structure, summaries and checks of Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import width
from ..functions.text import fence_positions, let, word_count


def _count(blocks: Column, kind: str) -> Column:
    return F.size(F.filter(blocks, lambda b: b["type"] == kind)).cast("long")


def block_words(b: Column) -> Column:
    """Words of texts, list items, table headers and cells; not of key values or captions."""
    total = lambda texts: F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + word_count(F.coalesce(t, F.lit(""))))
    none = F.array().cast("array<string>")
    return (
        F.when(b["type"] == "list", total(F.transform(b["items"], lambda i: i["text"])))
        .when(b["type"] == "table", total(F.concat(F.coalesce(b["header"], none), F.flatten(F.coalesce(b["rows"], F.array().cast("array<array<string>>"))))))
        .when(b["type"] == "key_values", F.lit(0).cast("long"))
        .otherwise(word_count(F.coalesce(b["text"], F.lit(""))))
    )


def measure(documents: DataFrame) -> DataFrame:
    """One row of counts per document. documents: doc_id, blocks; removed_running (array) if known."""
    b = F.col("blocks")
    sum_of = lambda f: F.aggregate(F.transform(b, f), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    cells = sum_of(lambda x: F.when(x["type"] == "table", width(x["rows"], x["header"]) * (F.size(x["rows"]) + F.when(F.coalesce(F.size(x["header"]), F.lit(0)) > 0, 1).otherwise(0))).otherwise(0).cast("long"))
    items = sum_of(lambda x: F.when(x["type"] == "list", F.size(x["items"])).otherwise(0).cast("long"))
    removed = F.coalesce(F.size("removed_running"), F.lit(0)) if "removed_running" in documents.columns else F.lit(0)
    pages = _count(b, "page_break")
    return documents.select(
        "doc_id", _count(b, "heading").alias("headings"), _count(b, "table").alias("tables"), cells.alias("table_cells"), _count(b, "list").alias("lists"), items.alias("list_items"),
        _count(b, "code").alias("code_blocks"), pages.alias("pages"), _count(b, "image").alias("images"), (removed * F.greatest(pages, F.lit(1))).cast("long").alias("running_headers_removed"),
        sum_of(block_words).alias("words"),
    )


def headline(measured: DataFrame) -> DataFrame:
    """Adds a sentence about the first three kinds of structure that were found."""
    some = lambda c, text: F.when(F.col(c) > 0, text)
    n = lambda c: F.col(c).cast("string")
    noun = F.when(F.col("tables") == 1, "table").otherwise("tables")
    parts = F.array(
        some("tables", F.concat(n("tables"), F.lit(" "), noun, F.lit(" ("), n("table_cells"), F.lit(" cells)"))), some("headings", F.concat(n("headings"), F.lit(" headings"))),
        some("list_items", F.concat(n("list_items"), F.lit(" list items"))), some("code_blocks", F.concat(n("code_blocks"), F.lit(" code blocks"))),
    )
    found = F.slice(F.filter(parts, lambda x: x.isNotNull()), 1, 3)
    suffix = F.when(F.col("running_headers_removed") > 0, F.concat(F.lit(", and dropped "), n("running_headers_removed"), F.lit(" repeated page headers"))).otherwise("")
    return measured.withColumn("headline", F.when(F.size(found) == 0, "Structure preserved, provenance attached.").otherwise(F.concat(F.lit("Recovered "), F.array_join(found, ", "), suffix, F.lit("."))))


def histogram(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode("blocks").alias("b")).groupBy("doc_id", F.col("b.type").alias("type")).agg(F.count("*").alias("n"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals by format and over all: converted, failed, words, chunks, warnings. results: format, failed, words, chunks, warnings."""
    return results.rollup("format").agg(
        F.count(F.when(~F.col("failed"), 1)).alias("converted"), F.count(F.when(F.col("failed"), 1)).alias("failed"),
        F.sum("words").alias("words"), F.sum("chunks").alias("chunks"), F.sum("warnings").alias("warnings"),
    )


def line_kinds(md: Column) -> Column:
    """Array of (line, kind): front matter, fence, heading, anchor, table or text."""

    def marked(lines: Column, last: Column, fences: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            fence = F.array_contains(fences, i) | (F.size(F.filter(fences, lambda f: f < i)) % 2 == 1)
            kind = F.when(i <= last, "fm").when(fence, "fence").when(line.rlike("^#{1,6} "), "h").when(line.startswith("<!-- "), "anchor").when(line.startswith("|"), "tbl").otherwise("text")
            return F.struct(line.alias("line"), kind.alias("kind"))

        return F.transform(lines, one)

    def of(lines: Column) -> Column:
        closed = F.array_position(F.slice(lines, 2, 1 << 30), F.lit("---")).cast("int")
        front = F.when(F.get(lines, F.lit(0)) != "---", -1).when(closed > 0, closed).otherwise(F.size(lines))  # the last line of the front matter
        return let(front, lambda last: let(F.filter(fence_positions(lines, "```"), lambda i: i > last), lambda fences: marked(lines, last, fences)))

    return let(F.split(md, "\n"), of)


def problems(md: Column) -> Column:
    """Names of structural faults: an open fence, ragged tables, malformed headings, trailing blanks, control characters."""
    lines = F.filter(line_kinds(md), lambda x: x["kind"] != "fm")
    fences = F.size(F.filter(F.transform(lines, lambda x: x["line"]), lambda x: x.rlike("^[ \\t]*```")))
    bars = lambda x: F.regexp_count(F.replace(x["line"], F.lit("\\|"), F.lit("")), F.lit("[|]"))
    rows = F.zip_with(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.slice(lines, 2, 1 << 30), lambda x, y: F.when((x["kind"] == "tbl") & (y["kind"] == "tbl"), bars(x) == bars(y)).otherwise(True))
    plain = F.filter(lines, lambda x: x["kind"] != "fence")
    checks = {
        "open_fence": fences % 2 == 1,
        "ragged_table": F.exists(rows, lambda ok: ~ok),
        "bad_heading": F.exists(plain, lambda x: x["line"].rlike("^#{7,} ") | x["line"].rlike("^#{1,6} *$")),
        "trailing_blank": F.exists(plain, lambda x: x["line"].rlike("[ \\t]$")),
        "control_character": md.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"),
    }
    return F.filter(F.array(*[F.when(test, name) for name, test in checks.items()]), lambda x: x.isNotNull())


def excerpt(md: Column, before: int = 12, after: int = 16, width_: int = 72) -> Column:
    """Lines around the first table, from a heading at most five lines above it if there is one, each cut to a width."""

    def of(lines: Column, table: Column) -> Column:
        at = F.when(table > 0, table).otherwise(F.lit(1))
        near = F.slice(lines, F.greatest(at - 5, F.lit(1)).cast("int"), F.least(F.lit(5), at - 1).cast("int"))
        up = F.array_position(F.reverse(F.transform(near, lambda x: x.rlike("^#{1,6} "))), F.lit(True))
        start = F.when((table > 0) & (up > 0), at - up).otherwise(F.greatest(at - before, F.lit(1)))
        return F.array_join(F.transform(let(start, lambda s: F.slice(lines, s.cast("int"), (at + after - s + 1).cast("int"))), lambda x: F.substring(x, 1, width_)), "\n")

    return let(F.split(md, "\n"), lambda lines: let(F.array_position(F.transform(lines, lambda x: x.startswith("|")), F.lit(True)), lambda table: of(lines, table)))
