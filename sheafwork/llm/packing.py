"""Packing: concatenate and cut.

Documents are tokenised once into a table that keeps, per row, its partition and
the prefix sum of token counts inside that partition. A second prefix sum over the
partitions' totals turns those into global offsets; fixed windows of 2048 tokens
over the concatenation give the sequences, and every piece of a document in a
window is one boundary record.

Defined results: null and empty texts are the end token alone; every row is packed,
repeated doc_ids and texts too; a text of any length is cut over as many sequences
as it needs; documents are concatenated in the order of the partitions and of the
rows in them, so ties need no rule; columns besides doc_id and text are not read,
whatever their names; an empty table gives no pieces. Only the last sequence can be
short.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, table
from .tokens import encoder, vocabulary

WINDOW = 2048
END = 1

def encoded(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, part, begin, n, ids): ids with the end token, begin counted inside the partition."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, begin = encoder(shared.value), TaskContext.get().partitionId(), 0
        end = END.to_bytes(4, "little")
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                ids = [x.astype("<u4", copy=False).tobytes() + end for x in encode.ids(piece.column(1))]
                sizes = [len(x) // 4 for x in ids]
                starts = []
                for n in sizes:
                    starts.append(begin)
                    begin += n
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "begin", "n", "ids"],
                )

    bounded_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, begin long, n long, ids binary")


def pack(space: Workspace, docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece, with the piece's ids."""
    spark = space.spark
    rows = space.store(encoded(spark, docs, tokenizer_path))
    # One number per partition of the token table: its size is the number of tasks, not of documents.
    totals = sorted((r["part"], r["total"]) for r in rows.groupBy("part").agg(F.sum("n").alias("total")).collect())
    bases, at = [], 0
    for part, total in totals:
        bases.append((part, at))
        at += total
    base = spark.createDataFrame(bases, "part int, base long")
    placed = rows.join(F.broadcast(base), "part").withColumn("g", F.col("base") + F.col("begin"))
    pieces = F.expr(
        f"""transform(sequence(g div {window}, (g + n - 1) div {window}), s -> struct(
            greatest(g, s * {window}) - g as start,
            least(g + n, (s + 1) * {window}) - greatest(g, s * {window}) as length,
            s as sequence_id,
            greatest(g, s * {window}) - s * {window} as offset,
            substring(ids, cast(4 * (greatest(g, s * {window}) - g) + 1 as int), cast(4 * (least(g + n, (s + 1) * {window}) - greatest(g, s * {window})) as int)) as piece_ids))"""
    )
    return placed.select("doc_id", F.col("n").alias("doc_tokens"), F.inline(pieces))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(Workspace(spark, "packing"), table(spark, sf_dir, "documents"), vocabulary()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as boundary records of full sequences."""
    return digest(pack(Workspace(spark, "packing"), docs, vocabulary()))
