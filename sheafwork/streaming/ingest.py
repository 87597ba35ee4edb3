"""Files that land in a folder, converted as they come, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import basename
from ..options import ConvertOptions
from ..plans import convert
from ..plans.sinks import write_chunks, write_documents


def landing(spark: SparkSession, path: str, watermark: str = "30 days", files_per_batch: int = 1000, max_file_age: str = "36500d") -> DataFrame:
    """(doc_id, filename, content, size_bytes) of new files; a content that came before within the watermark is dropped.

    Time is the arrival, when the stream first reads a file, so a file copied in with
    an old date is as new as any other, down to max_file_age before the newest one; the
    driver remembers the paths of that time. files_per_batch bounds what one batch holds.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_batch)).option("maxFileAge", max_file_age)
    rows = reader.load(path).withColumn("arrived", F.current_timestamp()).withColumn("sha", F.sha2("content", 256))
    once = rows.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["sha"])
    return once.select(F.col("path").alias("doc_id"), basename(F.col("path")).alias("filename"), "content", F.col("length").alias("size_bytes"))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, options: ConvertOptions | None = None) -> StreamingQuery:
    """Convert what has landed so far and stop; a restart goes on from the checkpoint.

    Each batch writes a folder named by its number, so a batch that is run again
    replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{out}/batch={number}"
        write_documents(convert.convert(batch, options), folder)
        # The chunks are made of what has been written, so a batch is parsed once and held nowhere.
        docs = batch.sparkSession.read.parquet(f"{folder}/documents").where("error is null")
        write_chunks(convert.chunk.chunks(docs, options), folder)

    return landing(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
