"""What a worker holds and how often an expression is evaluated do not grow with the table."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafwork.functions import text as T
from sheafwork.functions.detect import with_detection
from sheafwork.operators import measure, text_blocks
from sheafwork.plans import chunk, convert
from sheafwork.sources.baseline import with_baseline
from sheafwork.sources.samples import files


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["rows", "bytes"])


MADE = {
    "files": lambda d: files(d, kind="txt"),
    "baseline": lambda d: with_baseline(with_detection(files(d, kind="txt"))),
    "parsed": lambda d: convert.documents(files(d, kind="md")).select("doc_id", "blocks"),
    "folded": lambda d: d.select("doc_id", T.nfkc(F.col("text"))),
    "packed": lambda d: chunk.packed(d.select("doc_id", F.lit(0).alias("pos"), "text", F.lit("prose").alias("kind"), F.lit(False).alias("is_heading")), 500),
}


@pytest.mark.parametrize("name", MADE)
def test_python_gets_bounded_batches(spark, name):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    docs = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a line of words\n"), 100).alias("text"))
    found = MADE[name](docs).mapInArrow(sizes, "rows long, bytes long").agg(F.max("rows"), F.max("bytes")).first()
    assert found[0] <= 256 and found[1] <= 4 << 20


def test_pieces_of_a_long_unit_do_not_carry_it(spark):
    """A unit of 2 MB in 5,000 pieces once took its whole text 5,000 times."""
    text = F.repeat(F.lit("x" * 399 + "\n"), 5000)
    units = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"), text.alias("text"), F.lit("prose").alias("kind"), F.lit(False).alias("is_heading"))
    assert chunk.packed(units, 500).agg(F.count("*"), F.sum(F.length("text"))).first() == (5000, 5000 * 399 + 1)


@pytest.mark.parametrize("made", [measure.excerpt, lambda c: text_blocks.classify(c)])
def test_a_text_is_split_once(spark, made):
    plan = spark.range(1).select(made(F.concat("id", F.lit("\n"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(cast(id") + plan.count("split(concat(cast(id") == 1
