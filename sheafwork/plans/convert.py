"""The whole way: files -> detection -> blocks -> Markdown and chunks."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import bounded
from ..functions.detect import with_detection
from ..functions.text import cut, let, title_from_filename
from ..operators import layout, text_blocks
from ..operators.measure import block_words, headline, measure
from ..options import ConvertOptions
from ..sources.baseline import with_baseline
from ..sources.parse import Parser, parsed
from . import chunk, render

CONVERTED_BY = "sheafwork"


def _structured(docs: DataFrame, o: ConvertOptions) -> DataFrame:
    """What parsers leave to the operators: whole texts are cut into blocks, pages of lines are read, a leading heading becomes the title.

    The results come out of a generator of one row, which keeps Catalyst from copying
    these expressions into every later use of a column.
    """
    made = ("blocks", "title", "title_source", "warnings", "metadata")

    def from_blocks(laid: Column) -> Callable[[Column], Column]:
        def out(blocks: Column) -> Column:
            lifted = let(F.when(text_blocks.titled(F.col("blocks")), text_blocks.lift_title(blocks, "type")), lambda x: F.struct(F.coalesce(x["rest"], blocks).alias("rest"), x["title"].alias("title")))
            scanned = F.coalesce((laid["empty"] > 0) & (laid["empty"] >= F.greatest(F.lit(1), F.floor(F.col("layout.number") / 2))), F.lit(False))
            warning = F.concat(laid["empty"].cast("string"), F.lit(" of "), F.col("layout.number").cast("string"), F.lit(" pages have no text; the file looks scanned."))
            more = F.concat(F.expr("substring(metadata, 1, length(metadata) - 1)"), F.when(F.col("metadata") == "{}", "").otherwise(","), F.lit('"removed_running_text":'), F.to_json(laid["removed"]), F.lit("}"))
            return let(
                lifted,
                lambda x: F.struct(
                    x["rest"].alias("blocks"), F.coalesce("title", x["title"]).alias("title"), F.when(x["title"].isNotNull(), "heading").otherwise(F.col("title_source")).alias("title_source"),
                    F.when(scanned, F.concat("warnings", F.array(warning))).otherwise(F.col("warnings")).alias("warnings"), F.when(laid.isNotNull(), more).otherwise(F.col("metadata")).alias("metadata"),
                ),
            )

        return out

    def of(laid: Column) -> Column:
        blocks = F.when(laid.isNotNull(), F.concat(laid["blocks"], F.col("blocks"))).otherwise(text_blocks.expand(F.col("blocks"), o.detect_headings))
        return let(blocks, from_blocks(laid))

    found = let(F.when(F.col("layout").isNotNull(), layout.as_blocks(F.col("layout"), o.detect_headings, o.keep_page_breaks)), of)
    return docs.select(*[c for c in docs.columns if c not in (*made, "layout")], F.inline(F.array(found)))


def documents(files: DataFrame, options: ConvertOptions | None = None, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """One row per file: detection, title, blocks, assets, warnings, error. files: doc_id, filename, content, size_bytes.

    parsers: further parsers by format or extension, before the registered ones.
    """
    o = options or ConvertOptions()
    rows = with_detection(files.withColumn("sha256", F.sha2("content", 256)))
    out = _structured(parsed(rows, o, parsers), o)
    named = title_from_filename(F.col("filename"))
    # Markdown keeps its own headings; every other document has a title at least by its name.
    out = out.withColumn("title_source", F.when(F.col("error").isNotNull(), F.lit(None)).otherwise(F.coalesce("title_source", F.lit("filename"))))
    out = out.withColumn("title", F.when(F.col("error").isNotNull(), F.lit(None)).otherwise(F.coalesce("title", named)))
    return out.withColumn("format", F.col("detection.format"))


@F.pandas_udf(T.StringType())
def _yaml(facts: pd.Series) -> pd.Series:
    import yaml

    dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)  # the one in C writes the same text

    def one(text: str) -> str:
        data = {k: v for k, v in json.loads(text).items() if k not in ("document", "assets", "warnings", "converted_at") or v}
        return "---\n" + yaml.dump(data, Dumper=dumper, sort_keys=False, allow_unicode=True, width=100).strip() + "\n---"

    return facts.map(one)


def with_frontmatter(docs: DataFrame, converted_at: str | None = None) -> DataFrame:
    """Adds ``frontmatter``, YAML about the source. The time is an argument, so that a rerun gives the same text."""
    words = F.aggregate(F.transform("blocks", block_words), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    source = F.struct("filename", "format", F.col("detection.media_type").alias("media_type"), F.col("size_bytes").alias("bytes"), "sha256")
    head = F.to_json(
        F.struct("title", source.alias("source"), F.lit(converted_at).alias("converted_at"), F.lit(CONVERTED_BY).alias("converted_by"), words.alias("word_count")), {"ignoreNullFields": "false"}
    )
    rest = F.to_json(F.struct(F.transform("assets", lambda a: a["filename"]).alias("assets"), F.col("warnings").alias("warnings")), {"ignoreNullFields": "false"})
    # The metadata is JSON already: the three objects become one.
    facts = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"document":'), F.coalesce("metadata", F.lit("{}")), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    bounded(docs.sparkSession)
    return docs.withColumn("frontmatter", _yaml(facts))


def convert(files: DataFrame, options: ConvertOptions | None = None, converted_at: str | None = None) -> DataFrame:
    """documents() and their ``markdown``; rows with an error have none."""
    o = options or ConvertOptions()
    docs = documents(files, o)
    if o.frontmatter:
        docs = with_frontmatter(docs, converted_at)
    out = render.markdown(docs, o)
    return out.withColumn("markdown", F.when(F.col("error").isNull(), F.col("markdown")))


def window(converted: DataFrame, offset: int = 0, most: int = 20_000) -> DataFrame:
    """(doc_id, text, next_offset, total): a piece of each Markdown text, ended at a blank line if one is near; next_offset is null at the end."""
    piece = cut(F.col("markdown"), offset, max(1000, most))
    end = F.length("text") + offset
    rows = converted.select("doc_id", piece.alias("text"), F.length("markdown").alias("total"))
    return rows.select("doc_id", "text", F.when(end < F.col("total"), end).alias("next_offset"), "total")


def chunks(files: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    return chunk.chunks(documents(files, options).where("error is null"), options)


def compare(files: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """A plain text extraction beside the conversion: doc_id, filename, format, title, baseline, markdown, warnings, counts of what was recovered, headline."""
    docs = convert(files, (options or ConvertOptions()).with_(frontmatter=False)).where("error is null")
    removed = F.from_json(F.get_json_object("metadata", "$.removed_running_text"), "array<string>")
    counted = headline(measure(docs.withColumn("removed_running", removed)))
    shown = docs.select("doc_id", "filename", "format", "title", "markdown", "warnings")
    return shown.join(with_baseline(with_detection(files)), "doc_id").join(counted, "doc_id")


def one(spark: SparkSession, data: bytes, filename: str, options: ConvertOptions | None = None, converted_at: str | None = None):
    """Convert one file; returns its Row, and raises if it can't be converted."""
    from ..sources.model import SourceError

    rows = spark.createDataFrame([(filename, filename, bytearray(data), len(data))], "doc_id string, filename string, content binary, size_bytes long")
    row = convert(rows, options, converted_at).first()
    if row["error"]:
        raise SourceError(row["error"]["code"], row["error"]["message"])
    return row
