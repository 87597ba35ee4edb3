"""The training-data pipeline: each stage is one operator, written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame. All but the last return the columns of documents.

Defined results at every stage: rows with a null doc_id, source, lang or text are rows
like others (a null text counts as empty, so the classifier judges it, no line is
removed of it, it is linked with nothing, its mix takes no words of it, and it packs
as the end token); texts of any length are worked on whole; of equal texts the one with
the smallest doc_id stays; rows repeated by the mix are packed one by one; columns
besides those of documents are passed through, whatever their names; an empty table
gives an empty one. Each operator's module states its own cases.

The line dedup runs before the n-gram join, so the join sees texts without lines
that stand elsewhere; the mix repeats or leaves out whole documents, and packing
cuts what is left into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafwork.llm import cube_mixing, jaccard_join, line_dedup, packing, quality_crf
from sheafwork.llm.common import Workspace, table

STAGES = [
    ("quality classifier", quality_crf.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("mixing sources to target weights", cube_mixing.stage),
    ("packing", packing.stage),
]

#: The classifier's training and the cube method's random walk have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a table in the shared folder."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = space.store(stage(spark, docs, sf_dir))
        if before is not None:
            space.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
