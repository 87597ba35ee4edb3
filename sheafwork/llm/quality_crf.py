"""Quality classifier: a linear-chain CRF over the lines of a document.

Every line gets the label good or bad. A line's evidence is its own features and
those of the lines before and after it; the chain adds label transitions. Document
labels are passed to the lines for training. The length-weighted mean of the
lines' forward-backward marginals, put through a fitted logistic link, is the
document's quality.

Only the text is an input of a score. Defined results: null text counts as empty;
an empty text is one empty line and gets a score like any other; texts of any length
are scored whole; repeated rows, and equal texts, get equal scores; a score of just
the threshold is accepted; columns besides doc_id and text are not read, whatever
their names; an empty table gives an empty result; with no usable label every score is 0.5, with labels of one class
every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .textbytes import Block, Lines, Words, blocks, per, running

#: Documents that the model is fitted on, at most (the bound of the training sample).
TRAIN_DOCUMENTS = 3000
#: Lines of a text that the model is fitted on, at most; longer texts are left out of the training, so its size is bounded.
TRAIN_LINES = 500
#: Score from which a document counts as good.
THRESHOLD = 0.7

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?")] = True
_END = np.zeros(256, bool)
_END[list(b".?!:;\"")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _own(block: Block, lines: Lines) -> np.ndarray:
    """Features of each line by itself."""
    data = block.data
    words = Words(block)
    upper = (data >= 65) & (data <= 90)
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    upper |= after_c3 & (data >= 0x80) & (data <= 0x9E)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0xC0)
    count = lambda mask: lines.count(running(mask)).astype(float)
    line_of = np.searchsorted(lines.start, words.start, "right") - 1
    n_words = per(line_of, lines.n).astype(float)
    same = np.zeros(words.n, bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (line_of[1:] == line_of[:-1])
    word = np.maximum(n_words, 1)
    size = np.maximum(lines.stop - lines.start, 1).astype(float)
    letters = count(letter)
    ratios = [
        count(upper) / np.maximum(letters, 1),
        count(_SYMBOL[data]) / word,
        count(data == 33) / word,
        count(data == 124) / word,
        per(line_of, lines.n, same) / word,
        per(line_of, lines.n, words.repeated(3, line_of)) / word,
        count(_DIGIT[data]) / size,
        count(_STOP[data]) / word,
    ]
    filled = lines.stop > lines.start
    ends = np.zeros(lines.n)
    ends[filled] = _END[data[lines.stop[filled] - 1]]
    rest = [ends, np.minimum(size / word / 12, 2), np.log1p(n_words) / 6, n_words < 5, letters / size]
    return np.column_stack([x for r in ratios for x in (np.minimum(r, 1), np.minimum(5 * r, 1))] + rest)


def line_features(block: Block) -> tuple[Lines, np.ndarray]:
    """Per line: own features, those of the neighbouring lines, flags for no neighbour, a constant."""
    lines = Lines(block)
    own = _own(block, lines)
    first = np.append(True, lines.row[1:] != lines.row[:-1])
    last = np.append(first[1:], True)
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return lines, np.column_stack([own, before, after, first, last, np.ones(lines.n)])


def _through(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds that a message of log-odds x has after the transition table t[from, to]."""
    return np.logaddexp(x + t[1, 1], t[0, 1]) - np.logaddexp(x + t[1, 0], t[0, 0])


def forward_backward(score: np.ndarray, length: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the forward messages (own evidence included) and backward messages.

    Chains lie one after another in ``score``; all chains advance together, so the
    number of steps is the longest chain's length.
    """
    begin = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    a, b = score.copy(), np.zeros(len(score))
    for k in range(1, int(length[0]) if len(length) else 0):
        at = begin[: np.searchsorted(-length, -k, "left")] + k
        a[at] = score[at] + _through(a[at - 1], t)
    for k in range(1, int(length[0]) if len(length) else 0):
        live = np.searchsorted(-length, -k, "left")
        at = begin[:live] + length[:live] - 1 - k
        b[at] = _through(b[at + 1] + score[at + 1], t.T)
    return a, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    weights: np.ndarray | None
    transition: np.ndarray
    slope: float
    offset: float

    def line_marginals(self, features: np.ndarray, length: np.ndarray) -> np.ndarray:
        a, b = forward_backward(features @ self.weights, length, self.transition)
        return _sigmoid(a + b)

    def raw(self, lines: Lines, features: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each document."""
        p = self.line_marginals(features, per(lines.row, n))
        size = np.maximum(lines.stop - lines.start, 1).astype(float)
        mean = np.clip(per(lines.row, n, p * size) / per(lines.row, n, size), 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), float(_sigmoid(np.array(self.offset))))
        if self.weights is not None:
            for block in blocks(column):
                lines, features = line_features(block)
                out[block.first : block.first + block.n] = _sigmoid(self.slope * self.raw(lines, features, block.n) + self.offset)
        return out


def fit(documents: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, epochs: int = 150) -> Model:
    """Maximise the conditional likelihood of the line labels (each its document's), then fit the link."""
    ones = float(labels.sum())
    if len(labels) == 0 or ones in (0.0, float(len(labels))):
        share = (ones + 1) / (len(labels) + 2)
        return Model(None, np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    length = np.array([len(d) for d in documents])
    x = np.concatenate(documents).astype(float)
    row = np.repeat(np.arange(len(length)), length)
    y = labels[row].astype(float)
    inner = np.flatnonzero(row[1:] == row[:-1])
    observed = np.array([[np.sum((y[inner] == u) & (y[inner + 1] == v)) for v in (0, 1)] for u in (0, 1)], float)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, epochs + 1):
        s = x @ w
        a, b = forward_backward(s, length, t)
        joint = np.zeros((len(inner), 2, 2))
        joint[:, 1, :] += a[inner, None]
        joint[:, :, 1] += (b + s)[inner + 1, None]
        joint += t
        joint = np.exp(joint - joint.max((1, 2), keepdims=True, initial=-np.inf))
        joint /= joint.sum((1, 2), keepdims=True)
        grads = ((y - _sigmoid(a + b)) @ x / len(y) - 1e-4 * w, (observed - joint.sum(0)) / len(y) - 1e-4 * t)
        for k, (value, grad) in enumerate(zip((w, t), grads, strict=True)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(w, t, 1.0, 0.0)
    p = model.line_marginals(x, length)
    size = np.concatenate(sizes)
    mean = np.clip(per(row, len(length), p * size) / per(row, len(length), size), 1e-4, 1 - 1e-4)
    z = np.log(mean / (1 - mean))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method for the one-variable logistic link
        q = _sigmoid(slope * z + offset)
        h = q * (1 - q) + 1e-9
        g = np.array([np.sum((labels - q) * z) - 1e-2 * slope, np.sum(labels - q)])
        m = np.array([[np.sum(h * z * z) + 1e-2, np.sum(h * z)], [np.sum(h * z), np.sum(h) + 1e-6]])
        d = np.linalg.solve(m, g)
        slope, offset = slope + float(np.clip(d[0], -1, 1)), offset + float(np.clip(d[1], -1, 1))
    model.slope, model.offset = slope, offset
    return model


def held_out() -> "F.Column":
    """Rows that are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for block in blocks(batch.column(2)):
            lines, features = line_features(block)
            cut = np.searchsorted(lines.row, np.arange(block.n + 1))
            size = np.maximum(lines.stop - lines.start, 1)
            packed += [np.column_stack([size[i:j], features[i:j]]).astype("<f4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "quality", "lines"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on the labelled documents, not held out, that come first in a hashed order of doc_id.

    A doc_id with several labels counts once, with the smallest.
    """
    bounded_batches(spark)
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    sample = sample.where(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) < TRAIN_LINES)
    rows = sample.mapInArrow(_featurise, "doc_id long, quality int, lines binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["lines"])))
    width = _own(Block(0, np.zeros(0, np.uint8), np.zeros(2, np.int64)), Lines(Block(0, np.zeros(0, np.uint8), np.zeros(2, np.int64)))).shape[1] * 3 + 4
    parts = [np.frombuffer(r["lines"], "<f4").reshape(-1, width) for r in rows]
    return fit([p[:, 1:] for p in parts], [p[:, 0].astype(float) for p in parts], np.array([r["quality"] for r in rows], float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    bounded_batches(docs.sparkSession)
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return docs.select("doc_id", out, "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, whose score reaches the threshold."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(text)) >= threshold))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(spark, docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, train(spark, docs, table(spark, sf_dir, "labels")))
