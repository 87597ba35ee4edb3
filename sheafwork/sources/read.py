"""Where files come from: folders as binary files, and columns of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SKIPPED_FOLDERS, basename


#: The most that Spark's binary reader takes into a row.
LARGEST = 1 << 30


def files(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """(doc_id, filename, content, size_bytes) of the files under a path, without those in skipped folders.

    The content of a file over ``LARGEST`` bytes is null; its size makes it an error
    row in the conversion. Both scans read the listing alone where the other one reads.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    rows = reader.load(path).where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS])))
    named = lambda part, content: part.select(F.col("path").alias("doc_id"), basename(F.col("path")).alias("filename"), content.alias("content"), F.col("length").alias("size_bytes"))
    # The reader fails on a file that it can't hold, so the length is a filter that it is given.
    return named(rows.where(F.col("length") <= LARGEST), F.col("content")).unionByName(named(rows.where(F.col("length") > LARGEST), F.lit(None).cast("binary")))


def column(df: DataFrame, key: str, text: str | Column, filename: str | Column) -> DataFrame:
    """The texts of a table's column as files."""
    content = F.encode(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), "UTF-8")
    name = filename if isinstance(filename, Column) else F.lit(filename)
    return df.select(F.col(key).alias("doc_id"), name.alias("filename"), content.alias("content")).withColumn("size_bytes", F.octet_length("content").cast("long"))
