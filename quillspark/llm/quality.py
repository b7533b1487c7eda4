"""Text quality by supervised subword embeddings.

A document is a bag of hashed features: character n-grams of three to five bytes, words, and pairs of neighbouring words (a
pair of equal words has a bucket of its own, so repetition shows whatever the word). Each bucket has a learned vector; a
document's vector is their average; a softmax over the two labels reads it. Vectors and output layer are trained by stochastic
gradient descent in numpy on a bounded sample, about `SAMPLE` documents a label.

Averages and the output layer are linear, so once trained each bucket folds into one number: the part it adds to the
difference of the two outputs. Scoring looks these up for all features of whole texts. Texts over `bytetext.CHUNK` bytes are
read in one piece as well.

Cases: null and empty texts have no features and score by the bias alone; each input row gives one row; extra columns are
ignored; without labels of both kinds all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import bound_batches
from .sampling import held_out, labelled_texts

BITS = 16
BUCKETS = 1 << BITS
DIMENSIONS = 16
ORDERS = (3, 4, 5)
SAMPLE = 600
MODULUS, REST = 4, 2
THRESHOLD = 0.7
_CHUNK = 1 << 18
_REPEAT = np.uint32(1)


def ngram_buckets(data: np.ndarray, order: int, bits: int = BITS, code: np.ndarray = bt.LOWER_AT) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte; the last order - 1 have none."""
    n = len(data) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    byte = code[data].astype(np.uint32)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h ^= byte[k : k + n]
        h *= np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, first of each row, valid) for each kind of feature over rows end to end; valid is 0 where there is none."""
    for order in ORDERS:
        buckets = ngram_buckets(data, order)
        valid = np.ones(len(buckets), np.float32)
        for back in range(1, order):
            ends = at[1:] - back
            valid[ends[(ends >= at[:-1]) & (ends < len(buckets))]] = 0
        yield buckets, np.minimum(at, len(buckets)), valid
    starts, ends, first = bt.word_spans(data, at, bt.SPACED)
    words = bt.word_hashes(data, starts, ends)
    yield (words >> np.uint64(64 - BITS)).astype(np.uint32), first, np.ones(len(words), np.float32)
    if len(words) > 1:
        pairs = bt.mix(words[:-1] * bt.U(bt.BASE) + words[1:]) >> np.uint64(64 - BITS)
        pairs = np.where(words[:-1] == words[1:], _REPEAT, pairs.astype(np.uint32))
        valid = np.ones(len(pairs), np.float32)
        edges = first[1:-1] - 1
        valid[edges[(edges >= 0) & (edges < len(pairs))]] = 0
        yield pairs, np.minimum(first, len(pairs)), valid


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over [at[i], at[i + 1])."""
    out = np.zeros(len(at) - 1)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, at[:-1][full])
    return out


def bags(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct buckets of each whole text and how often each occurs."""
    buckets: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for _, _, data, at in bt.chunks(texts, _CHUNK):
        kinds = list(features(data, at))
        for i in range(len(at) - 1):
            mine = np.concatenate([b[f[i] : f[i + 1]][v[f[i] : f[i + 1]] > 0] for b, f, v in kinds])
            b, c = np.unique(mine, return_counts=True)
            buckets.append(b.astype(np.int32))
            counts.append(c.astype(np.int32))
    return buckets, counts


class Model:
    def __init__(self, parts: np.ndarray, bias: float):
        self.parts, self.bias = parts.astype(np.float32), bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for row, end, data, at in bt.chunks(texts, _CHUNK):
            total, number = np.zeros(end - row), np.zeros(end - row)
            for buckets, first, valid in features(data, at):
                total += row_sums(self.parts[buckets] * valid, first)
                number += row_sums(valid, first)
            out[row:end] = total / np.maximum(number, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def fit(documents: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.5, seed: int = 5) -> Model:
    """Trains vectors and output layer on (label, buckets, counts); both labels weigh the same."""
    documents = sorted((d for d in documents if len(d[1])), key=lambda d: (d[0], len(d[1]), d[1].tobytes(), d[2].tobytes()))
    labels = np.array([d[0] for d in documents])
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    share = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels != 1).mean())
    step, total = 0, epochs * len(documents)
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            label, buckets, counts = documents[i]
            weight = (counts / counts.sum()).astype(np.float32)
            mine = vectors[buckets]
            hidden = weight @ mine
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(label == 1)] -= 1
            pace = rate * share[i] * (1 - step / total)
            back = p @ output
            output -= pace * np.outer(p, hidden) / max(1.0, float(hidden @ hidden))
            bias -= 0.1 * pace * p
            # features share the step so that the document's own vector moves by it, whatever the text's length; none takes over eight parts
            parts = np.minimum(weight * len(buckets), 8)
            vectors[buckets] = (1 - 1e-4 * pace) * mine - (pace / (weight @ parts)) * parts[:, None] * back
            step += 1
    return Model(vectors @ (output[1] - output[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, modulus: int = MODULUS, rest: int = REST) -> Model:
    """Fits to a bounded sample of labelled documents; their bags, not their texts, come to the driver."""
    bound_batches(docs.sparkSession)
    sample = labelled_texts(docs, labels, "quality", modulus, rest, most, 13)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = bags(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.astype("<i4").tobytes() for b in buckets], pa.binary()), pa.array([c.astype("<i4").tobytes() for c in counts], pa.binary())], names=["label", "buckets", "counts"])

    rows = sample.mapInArrow(each, "label int, buckets binary, counts binary").toLocalIterator()
    return fit([(r.label, np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<i4")) for r in rows])


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels))  # 256 kB, whatever the corpus
    bound_batches(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", "predicted")
