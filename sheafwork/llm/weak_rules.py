"""Quality rules as weak supervision.

Each rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation over
the counts of vote patterns of all documents that pass the base test (the others are
decided) estimates how each rule votes in either class; a document's posterior probability of being good replaces a filter that all
rules must pass.

Defined results: null text counts as empty and, like every text under 50 words,
fails the base test; repeated rows get equal results; on an empty table the result
is empty; identical vote patterns get identical posteriors, and a posterior of just
``KEEP_FROM`` is kept; texts of any length are counted whole; columns besides doc_id
and text are not read, whatever their names. Words are runs of
characters other than the space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, table
from .textbytes import SPACE, Lines, Words, blocks, per, running, span_hash

MIN_WORDS = 50
KEEP_FROM = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_END = np.zeros(256, bool)
_END[list(b".?!:;\"")] = True

_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_ended long, n_letters long, n_upper long, n_adjacent long, n_marks long, n_distinct long"
)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for block in blocks(batch.column(1)):
            data, n = block.data, block.n
            words, lines = Words(block), Lines(block)
            whole = lambda mask: np.diff(running(mask)[block.bounds])  # noqa: E731,B023
            solid = ~SPACE[data]
            used = lines.count(running(solid)) > 0
            key = span_hash(data, lines.start, lines.stop) + lines.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at = np.flatnonzero(used)
            _, first = np.unique(key[at], return_index=True)
            again = np.ones(len(at), bool)
            again[first] = False
            ended = np.zeros(lines.n, bool)
            trimmed = lines.stop > lines.start
            ended[trimmed] = _END[data[lines.stop[trimmed] - 1]]
            after_c3 = np.zeros(len(data), bool)
            after_c3[1:] = data[:-1] == 0xC3
            upper = ((data >= 65) & (data <= 90)) | (after_c3 & (data >= 0x80) & (data <= 0x9E))
            letter = (((data | 32) >= 97) & ((data | 32) <= 122)) | (data >= 0xC0)
            same = np.zeros(words.n, bool)
            same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
            distinct = np.unique(words.hash + words.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
            parts.append(
                [
                    per(words.row, n), whole(solid & ((data & 0xC0) != 0x80)), whole(_SYMBOL[data]), per(lines.row[at[again]], n),
                    per(words.row[words.repeated(3)], n), per(lines.row[used], n), per(lines.row[used & ended], n), whole(letter), whole(upper),
                    per(words.row[same], n), whole((data == 33) | (data == 124)), per(words.row[distinct], n),
                ]
            )
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 12
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in columns)], [f.split()[0] for f in _SCHEMA.split(", ")])


def measures(docs: DataFrame) -> DataFrame:
    """Counts of every whole text that the base test and the rules use."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_measure, _SCHEMA)


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains."""

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)

    def share(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))

    def between(x: Column, good: float, bad: float) -> Column:
        return vote(x, x <= good, x > bad)

    size, n = share("word_chars", "n_words"), F.col("n_words")
    ended, rich, letters = share("n_ended", "n_lines"), share("n_distinct", "n_words"), share("n_letters", "word_chars")
    return {
        "length": vote(n, n >= 100, n < 60),
        "word_size": vote(size, (size >= 3) & (size <= 8), (size < 2) | (size > 12)),
        "symbols": between(share("n_symbols", "n_words"), 0.03, 0.1),
        "duplicate_lines": F.when(F.col("n_lines") < 3, 0).otherwise(between(share("n_dup_lines", "n_lines"), 0.05, 0.3)),
        "repeated_words": between(share("n_repeat_words", "n_words"), 0.15, 0.35),
        "capitals": between(share("n_upper", "n_letters"), 0.1, 0.3),
        "stutter": between(share("n_adjacent", "n_words"), 0.03, 0.15),
        "letters": vote(letters, letters >= 0.9, letters < 0.85),
        "marks": between(share("n_marks", "n_words"), 0.03, 0.15),
        "line_ends": vote(ended, ended >= 0.6, ended < 0.2),
        "vocabulary": F.when(n < 30, 0).otherwise(vote(rich, rich >= 0.3, (rich < 0.08) & (n < 2000))),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(log-odds of the prior, per rule and vote -1, 0, 1 the log-likelihood ratio good to bad), by EM.

    Starts from a prior of 0.8, rules that hardly ever call a good document bad, and
    bad documents of which each rule sees half; a rule never becomes evidence against
    its own vote.
    """
    j = patterns.shape[1]
    hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    p = np.zeros((2, j, 3))
    silent = np.einsum("n,njv->jv", counts, hot)[:, 1] / max(counts.sum(), 1)
    p[0] = np.column_stack([0.5 * (1 - silent), silent, 0.5 * (1 - silent)])
    p[1] = np.column_stack([0.01 * (1 - silent), silent, 0.99 * (1 - silent)])
    p = (p + 1e-3) / (1 + 3e-3)
    prior = 0.8
    for _ in range(rounds):
        z = np.log(prior / (1 - prior)) + np.einsum("njv,jv->n", hot, np.log(p[1] / p[0]))
        q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        old = p.copy()
        for y, w in ((0, counts * (1 - q)), (1, counts * q)):
            total = np.einsum("n,njv->jv", w, hot)
            p[y] = (total + 0.5) / (w.sum() + 1.5)
        prior = float(np.clip((counts * q).sum() / max(counts.sum(), 1e-9), 0.01, 0.99)) if counts.sum() else 0.8
        if np.abs(p - old).max() < 1e-9:
            break
    ratio = np.log(p[1] / p[0])
    ratio[:, 0], ratio[:, 2] = np.minimum(ratio[:, 0], 0), np.maximum(ratio[:, 2], 0)
    return float(np.log(prior / (1 - prior))), ratio


def judge(space: Workspace, docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The counts of each row, base_failed, the votes, posterior and kept."""
    votes = rules()
    counted = space.store(measures(docs)).withColumns({f"vote_{k}": v for k, v in votes.items()})
    names = [f"vote_{k}" for k in votes]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    # At most 3 to the power of the number of rules patterns, whatever the number of documents.
    seen = sorted(tuple(r) for r in counted.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n")).collect())
    table_ = np.array(seen, float).reshape(-1, len(names) + 1)
    start, ratio = estimate(table_[:, :-1], table_[:, -1])
    terms = [F.when(F.col(c) < 0, float(r[0])).when(F.col(c) > 0, float(r[2])).otherwise(float(r[1])) for c, r in zip(names, ratio, strict=True)]
    posterior = 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(start))))
    return counted.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(Workspace(spark, "weak_rules"), table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
