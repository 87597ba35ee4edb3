"""Command line: ``python -m sheafwork.cli convert|chunk|inspect|formats|version``; runs in the session of spark-submit or a local one."""

from __future__ import annotations

import argparse
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sheafwork")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("convert", "chunk"):
        p = verbs.add_parser(verb)
        p.add_argument("paths", nargs="+")
        p.add_argument("-o", "--out", help="folder for documents, assets and chunks")
        p.add_argument("-r", "--recursive", action="store_true")
        p.add_argument("--chunk", action="store_true")
        p.add_argument("--ir", action="store_true", help="also write the documents as JSON")
        p.add_argument("--bundles", action="store_true", help="also write a folder of files for each document")
        p.add_argument("--chunk-size", type=int, default=1200)
        p.add_argument("--chunk-overlap", type=int, default=120)
        p.add_argument("--frontmatter", action=argparse.BooleanOptionalAction, default=True)
        p.add_argument("--page-anchors", action=argparse.BooleanOptionalAction, default=True)
        p.add_argument("--images", choices=("extract", "reference", "placeholder", "omit"), default="reference")
        p.add_argument("--tables", choices=("pipe", "html", "csv"), default="pipe")
        p.add_argument("--hidden-sheets", action="store_true")
        p.add_argument("--max-mb", type=int, default=50)
    p = verbs.add_parser("inspect")
    p.add_argument("path")
    p.add_argument("--show", type=int, default=20)
    verbs.add_parser("formats")
    verbs.add_parser("version")
    return top


def inspect(documents: DataFrame) -> DataFrame:
    """Per document: format, title, blocks by type, words, warnings, error."""
    kinds = F.transform("blocks", lambda b: b["type"])
    counts = F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.concat(k, F.lit(" "), F.size(F.filter(kinds, lambda x: x == k)).cast("string")))
    return documents.select("doc_id", "format", "title", F.array_join(counts, ", ").alias("structure"), "warnings", "error")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from . import __version__, bundles, chunks, convert, documents, files, receipts, unique_stems, write_json, write_jsonl, write_tables
    from .functions.detect import PARSERS
    from .options import ConvertOptions, Limits

    args = _parser().parse_args(argv)
    if args.verb == "version":
        print(__version__)
        return 0
    if args.verb == "formats":
        for fmt, _, label in sorted(PARSERS):
            print(f"{fmt:10} {label}")
        return 0
    spark = spark or SparkSession.builder.appName("sheafwork").getOrCreate()
    if args.verb == "inspect":
        inspect(documents(files(spark, args.path))).show(args.show, truncate=False)
        return 0
    options = ConvertOptions(
        frontmatter=args.frontmatter, page_anchors=args.page_anchors, images=args.images, table_format=args.tables, include_hidden_sheets=args.hidden_sheets,
        chunk_size=args.chunk_size, chunk_overlap=args.chunk_overlap, limits=Limits(max_file_bytes=args.max_mb << 20),
    )
    found = reduce(DataFrame.unionByName, [files(spark, p, args.recursive) for p in args.paths])
    if not args.out and (args.ir or args.bundles or found.limit(2).count() > 1):
        print("several files, --ir and --bundles need a folder: --out", file=sys.stderr)
        return 2
    if args.out:
        docs = convert(found, options).persist()
        from .plans import chunk

        rows = chunk.chunks(docs.where("error is null"), options)
        write_tables(docs, rows, args.out)
        if args.chunk or args.verb == "chunk":
            write_jsonl(rows, f"{args.out}/chunks_jsonl")
        if args.ir:
            write_json(docs, f"{args.out}/documents_json")
        if args.bundles:
            stems = unique_stems(docs.where("error is null").select("doc_id", "filename"), "doc_id", "filename").select("doc_id", "stem")
            bundles(docs.join(stems, "doc_id"), os.path.abspath(f"{args.out}/bundles"), rows).count()
        for r in receipts(docs).where("error is not null").select("doc_id", "error.message").limit(100).collect():
            print(f"{r['doc_id']}: {r['message']}", file=sys.stderr)
        total, failed = docs.agg(F.count("*"), F.count("error")).first()
        docs.unpersist()
        print(f"{total - failed} converted, {failed} failed", file=sys.stderr)
        return int(total == failed)
    if args.verb == "chunk":
        for r in chunks(found, options).toLocalIterator():
            print(r["id"], r["text"], sep="\n")
        return 0
    total = failed = 0
    for r in convert(found, options).select("doc_id", "markdown", "error").toLocalIterator():
        total += 1
        if r["error"]:
            failed += 1
            print(f"{r['doc_id']}: {r['error']['message']}", file=sys.stderr)
        else:
            print(r["markdown"])
    return int(total == failed)


if __name__ == "__main__":
    sys.exit(main())
