"""Heading-aware chunks: units with their heading path and page, packed greedily inside each document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.batches import bounded
from ..functions.text import estimate_tokens, slugify_ascii, strip, tail
from ..options import ConvertOptions
from . import render

def carry_page(rows: DataFrame, key: str = "doc_id", order: str = "pos", page: str = "page") -> DataFrame:
    """Gives each row the page of the last row up to it that names one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("page", F.last(page, ignorenulls=True).over(w))


def heading_path(rows: DataFrame, key: str = "doc_id", order: str = "pos", level: str = "level", text: str = "text", title: str | None = None) -> DataFrame:
    """Adds ``path``: the headings in force at each row, the outermost first. ``level`` is null but for headings.

    A heading of level k is in force until a heading of level k or less follows.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = lambda test, value: F.last(F.when(test, F.col(value)), ignorenulls=True).over(w)
    names = {}  # all in one step: one window, not one for each
    for k in range(1, 7):
        names |= {f"__h{k}": at(F.col(level) == k, text), f"__p{k}": at(F.col(level) == k, order), f"__o{k}": at(F.col(level) < k, order)}
    out = rows.withColumns(names)
    parts = [F.when(F.coalesce(F.col(f"__p{k}") > F.col(f"__o{k}"), F.col(f"__p{k}").isNotNull()), F.col(f"__h{k}")) for k in range(1, 7)]
    top = [F.col(title)] if title else []
    return out.withColumn("path", F.filter(F.array(*top, *parts), lambda x: x.isNotNull() & (x != ""))).drop(*names)


def units(documents: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """(doc_id, source, pos, text, path, page, is_heading, kind) of every block that renders to something."""
    source = F.struct("filename", "sha256", "format").alias("source")
    rows = documents.select("doc_id", source, "title", F.posexplode("blocks").alias("pos", "b"))
    rows = rows.select("doc_id", "source", "title", "pos", "b", F.col("b.page").alias("page"), F.when(F.col("b.type") == "heading", F.coalesce("b.level", F.lit(1))).alias("level"), F.col("b.text").alias("heading"))
    rows = heading_path(carry_page(rows), text="heading", title="title")
    kind = F.when(F.col("b.type").isin("table", "code"), F.col("b.type")).otherwise("prose")
    md = render.block(F.col("b"), options)
    out = rows.select("doc_id", "source", "pos", md.alias("text"), "path", "page", (F.col("b.type") == "heading").alias("is_heading"), kind.alias("kind"), F.col("b.type").alias("type"))
    return out.where((F.col("type") != "page_break") & (strip("text") != "")).drop("type")


def split_oversized(text: str, kind: str, target: int) -> list[str]:
    """Pieces of a unit that is too long: whole lines, a table's first two lines on each, code fenced anew.

    A single line longer than the target stays whole.
    """
    lines = text.split("\n")
    head, body, fence = [], lines, ""
    if kind == "table" and len(lines) > 2 and lines[0].startswith("|"):
        head, body = lines[:2], lines[2:]
    elif kind == "code" and (m := re.match(r"[ \t]*(`{3,})", lines[0])):
        fence = m[1]
        body = lines[1:-1] if len(lines) > 1 and re.match(r"[ \t]*```", lines[-1]) else lines[1:]
    room = target - sum(len(x) + 1 for x in head)
    begins, size = [], 0
    for i, line in enumerate(body):
        if not begins or size + len(line) > room:
            begins.append(i)
            size = 0
        size += len(line) + 1
    pieces = [body[i:j] for i, j in zip(begins, [*begins[1:], len(body)], strict=True)]
    if fence:
        return ["\n".join([lines[0], *p, fence]) for p in pieces] or [text]
    return ["\n".join(head + p) for p in pieces] or [text]


def packed(units: DataFrame, target: int, key: str = "doc_id") -> DataFrame:
    """Adds ``piece`` and ``grp``: units of a document, in the order of ``pos``, packed into groups up to the target.

    A heading closes a group that is over 35 % full; a unit that would pass the
    target closes the group before it; a unit over 1.5 targets is cut into pieces,
    each a group of its own. units: key, pos, text, kind, is_heading and any other
    columns, which the pieces of a unit share. One sort by document and one pass over
    it: a group's number and size are all that is kept between rows.
    """
    schema = StructType([*units.schema.fields, StructField("piece", LongType()), StructField("grp", LongType())])
    names = units.columns
    at = {c: names.index(c) for c in (key, "text", "kind", "is_heading")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, size, group, shut = object(), 0, 0, False
        for batch in batches:
            columns = [batch.column(at[c]).to_pylist() for c in (key, "text", "kind", "is_heading")]
            rows, texts, pieces, groups = [], [], [], []
            for i, (d, text, kind, heading) in enumerate(zip(*columns, strict=True)):
                if d != doc:
                    doc, size, group, shut = d, 0, 0, False
                long = len(text) > target * 1.5
                for k, piece in enumerate(split_oversized(text, kind, target) if long else [text]):
                    full = (heading and not long and size > target * 0.35) or (size > 0 and size + len(piece) > target)
                    if (size or shut) and (full or shut or long):
                        group += 1
                        size = 0
                    size = 0 if long else size + len(piece) + 2
                    shut = long
                    rows.append(i)
                    texts.append(piece)
                    pieces.append(k)
                    groups.append(group)
            places = pa.array(rows, pa.int32())  # the whole text is not taken again for each of its pieces
            out = [pa.array(texts, batch.column(j).type) if j == at["text"] else batch.column(j).take(places) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(pieces, pa.int64()), pa.array(groups, pa.int64())], [*names, "piece", "grp"])

    bounded(units.sparkSession)
    return units.repartition(key).sortWithinPartitions(key, "pos").mapInArrow(run, schema)


def chunks(documents: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """(doc_id, id, index, text, heading_path, pages, char_count, token_estimate, source) of every chunk.

    documents: doc_id, title, blocks, filename, sha256, format.
    """
    o = (options or ConvertOptions()).clamped().with_(frontmatter=False)
    target, overlap = o.chunk_size, min(o.chunk_overlap, o.chunk_size // 2)
    rows = packed(units(documents, o), target)
    rows = rows.select("doc_id", "source", "grp", F.struct("pos", "piece", "text", "path", "page", "kind").alias("u"))
    joined = rows.groupBy("doc_id", "grp").agg(F.first("source").alias("source"), F.sort_array(F.collect_list("u")).alias("us"))
    text = strip(F.array_join(F.transform("us", lambda u: u["text"]), "\n\n"))
    grouped = joined.select(
        "doc_id", "source", "grp", text.alias("body"), F.get("us", F.lit(0))["path"].alias("heading_path"), F.forall("us", lambda u: u["kind"] == "prose").alias("prose"),
        F.array_sort(F.array_distinct(F.filter(F.transform("us", lambda u: u["page"]), lambda p: p.isNotNull()))).alias("pages"),
    ).where("body <> ''")
    w = Window.partitionBy("doc_id").orderBy("grp")
    before, before_prose = F.lag("body").over(w), F.lag("prose").over(w)
    prefix = F.when(F.lit(overlap > 0) & F.col("prose") & F.coalesce(before_prose, F.lit(False)), tail(before, max(overlap, 1))).otherwise("")
    full = F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("\n\n"), F.col("body"))).otherwise(F.col("body"))
    out = grouped.select("doc_id", "source", (F.row_number().over(w) - 1).alias("index"), full.alias("text"), "heading_path", "pages")
    ident = F.concat(slugify_ascii(F.coalesce("source.filename", F.lit("doc")), 40), F.lit("-"), F.lpad(F.col("index").cast("string"), 4, "0"))
    return out.select("doc_id", ident.alias("id"), "index", "text", "heading_path", "pages", F.length("text").alias("char_count"), estimate_tokens(F.col("text")).alias("token_estimate"), "source")


def to_jsonl(chunk_rows: DataFrame) -> DataFrame:
    """One JSON text per chunk, in the column ``value``."""
    return chunk_rows.select(F.to_json(F.struct("id", "index", "text", "heading_path", "pages", "char_count", "token_estimate", "source"), {"ignoreNullFields": "false"}).alias("value"))
