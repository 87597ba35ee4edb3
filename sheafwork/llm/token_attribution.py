"""Token counts by offset-mapped attribution.

Whole documents are encoded once. Every token keeps the span of characters that it
came from, and the spans are interval-joined to sections of the text: both are
sorted, so the join is a search of each span's ends among the sections' bounds.
A token that touches several sections is allocated by an explicit rule:

* ``majority``: to the section that holds most of its characters, the earlier one
  at a tie;
* ``first``: to the first section that it touches;
* ``fraction``: to each in proportion to its characters.

Defined results: null text counts as empty and has no section (or, with own
sections, zeros); tokens that touch no section count for none and are reported as
``outside``; repeated rows are counted one by one; texts of any length are encoded
whole; columns besides doc_id, text and those that the sections are made of are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .tokens import encoder, vocabulary

RULES = ("majority", "first", "fraction")
#: Code points of a section of the registered query.
SECTION = 1000


def allocate(first: np.ndarray, end: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens of each section, tokens that cross its bounds, tokens outside all).

    Spans are sorted by first character; sections are sorted and disjoint, gaps
    allowed. A token of no characters lies where it begins.
    """
    n = len(starts)
    count, cross = np.zeros(n), np.zeros(n, np.int64)
    if n == 0 or len(first) == 0:
        return count, cross, len(first)
    end = np.maximum(end, first + 1)
    low = np.searchsorted(stops, first, "right")  # the first section that ends after the token begins
    high = np.searchsorted(starts, end, "left")  # one past the last that begins before it ends
    touched = high - low
    one = touched == 1
    inside = one & (starts[np.minimum(low, n - 1)] <= first) & (end <= stops[np.minimum(low, n - 1)])
    count += np.bincount(low[one], minlength=n)
    cross += np.bincount(low[one & ~inside], minlength=n)
    for t in np.flatnonzero(touched > 1):
        share = np.minimum(stops[low[t] : high[t]], end[t]) - np.maximum(starts[low[t] : high[t]], first[t])
        cross[low[t] : high[t]] += 1
        if rule == "fraction":
            count[low[t] : high[t]] += share / share.sum()
        else:
            count[low[t] + (int(share.argmax()) if rule == "majority" else 0)] += 1
    return count, cross, int((touched <= 0).sum())


def windows(text: Column, size: int = SECTION) -> Column:
    """Bounds of sections of ``size`` code points: an array of (start, stop)."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.struct((k * size).alias("start"), F.least(n, (k + 1) * size).alias("stop"))))


def lines(text: Column) -> Column:
    """Bounds of the lines, without their line feeds, as an array of (start, stop)."""
    parts = F.split(text, "\n")
    zero = F.array().cast("array<struct<start:int,stop:int>>")
    ends = F.transform(parts, lambda x: F.length(x) + 1)
    total = F.transform(parts, lambda _, i: F.aggregate(F.slice(ends, 1, i + 1), F.lit(0), lambda a, x: a + x))
    return F.coalesce(F.zip_with(parts, total, lambda p, e: F.struct((e - 1 - F.length(p)).alias("start"), (e - 1).alias("stop"))), zero)


def attribute(docs: DataFrame, sections: Column, tokenizer_path: str, rule: str = "majority") -> DataFrame:
    """(doc_id, section, start, stop, n_tokens, n_crossing, doc_tokens, outside), one row per section.

    ``sections`` gives each row's sorted disjoint bounds as an array of (start, stop)
    in code points.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary: a few MB
    item = "struct<section:int,start:int,stop:int,n_tokens:double,n_crossing:long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                bounds = piece.column(2)
                total, outside, found, sizes = [], [], [], []
                for k, (first, end) in enumerate(encode.spans(piece.column(1))):
                    own = bounds[k].values
                    starts, stops = (own.field(i).to_numpy(zero_copy_only=False) if own is not None else np.zeros(0, np.int32) for i in (0, 1))
                    count, cross, out = allocate(first, end, starts, stops, rule)
                    total.append(len(first))
                    outside.append(out)
                    sizes.append(len(starts))
                    found.append((np.arange(len(starts), dtype=np.int32), starts, stops, count, cross))
                flat = [np.concatenate(c) for c in zip(*found, strict=True)]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
                names = ["section", "start", "stop", "n_tokens", "n_crossing"]
                values = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(flat, kinds, strict=True)], names)
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(total, pa.int64()), pa.array(outside, pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "doc_tokens", "outside", "found"]
                )

    bounded_batches(spark)
    out = docs.select("doc_id", "text", sections.alias("sections")).mapInArrow(run, f"doc_id long, doc_tokens long, outside long, found array<{item}>")
    return out.select("doc_id", "doc_tokens", "outside", F.inline("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attribute(table(spark, sf_dir, "documents"), windows(F.col("text")), vocabulary())
    return out.select("doc_id", "section", "start", "stop", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing", "doc_tokens")
