"""Language identification by multinomial naive Bayes over hashed character n-grams.

Text is read as UTF-8 bytes, A-Z as a-z, every other ASCII byte as a space; n-grams of two to four bytes are hashed to `BITS`
bits. Their counts by language, summed on the executors over a sample of at most about `SAMPLE` documents a language, give a
matrix of log probabilities (buckets by languages) that is broadcast; its size is fixed by the number of languages. Scoring
adds, for each whole text and language, the log probabilities of all its n-grams, in numpy over batches end to end.

score: the posterior of the language predicted, over the root of the number of n-grams, since neighbouring n-grams aren't
independent. Cases: null texts and texts without a letter are `und` with score 0; each input row gives one row; rows with a
null lang teach nothing; equal posteriors go to the language first by code point; without any language all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import bound_batches
from .quality import ngram_buckets, row_sums
from .sampling import held_out, per_class

BITS = 16
ORDERS = (2, 3, 4)
SAMPLE = 1500
MODULUS, REST = 4, 2
SMOOTHING = 0.1
_CHUNK = 1 << 18


def _letters() -> np.ndarray:
    code = np.full(256, 32, np.uint8)
    code[97:123] = np.arange(97, 123)
    code[65:91] = np.arange(97, 123)
    code[128:] = np.arange(128, 256)
    return code


LETTERS = _letters()


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, first of each row, valid): n-grams of blanks alone and those that leave their row are not valid."""
    blank = LETTERS[data] == 32
    for order in ORDERS:
        buckets = ngram_buckets(data, order, BITS, LETTERS)
        n = len(buckets)
        empty = blank[:n].copy()
        for k in range(1, order):
            empty &= blank[k : k + n]
        valid = (~empty).astype(np.float32)
        for back in range(1, order):
            ends = at[1:] - back
            valid[ends[(ends >= at[:-1]) & (ends < n)]] = 0
        yield buckets, np.minimum(at, n), valid


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray):
        self.langs, self.table, self.prior = langs, table.astype(np.float32), prior

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each whole text."""
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        total, number = np.zeros((n, len(self.langs))), np.zeros(n)
        for row, end, data, at in bt.chunks(texts, _CHUNK):
            for buckets, first, valid in grams(data, at):
                number[row:end] += row_sums(valid, first)
                for k in range(len(self.langs)):
                    total[row:end, k] += row_sums(self.table[k][buckets] * valid, first)
        total += self.prior
        best = total.argmax(axis=1)
        p = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(number, 1))[:, None])
        p /= p.sum(axis=1, keepdims=True)
        known = has_letter(texts)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(n), best], 0.0)


def train(docs: DataFrame, most: int = SAMPLE, modulus: int = MODULUS, rest: int = REST) -> Model:
    """Sums n-gram counts by language on the executors; languages times 2**16 sums at most come to the driver."""
    bound_batches(docs.sparkSession)
    learn = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
    sample = per_class(learn, "lang", most, 17).select("lang", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                mine = np.flatnonzero(langs == lang)
                table = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                rows[lang] = rows.get(lang, 0) + len(mine)
                for _, _, data, at in bt.chunks(batch.column(1).take(pa.array(mine)), _CHUNK):
                    for buckets, _, valid in grams(data, at):
                        table += np.bincount(buckets[valid > 0], minlength=1 << BITS)
        for lang, table in sums.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(table[used], rows[lang]))], names=["lang", "bucket", "n"])

    got = sample.mapInArrow(each, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(got.column("lang").to_pylist(), object)
    langs = sorted(set(names))
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    counts = np.full((len(langs), 1 << BITS), SMOOTHING)
    documents = np.ones(len(langs))
    for k, lang in enumerate(langs):
        mine = (names == lang) & (bucket >= 0)
        counts[k, bucket[mine]] += n[mine]
        documents[k] = n[(names == lang) & (bucket < 0)].sum()
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(documents / documents.sum()))


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs))
    bound_batches(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, p = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(p)], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "lang_pred", "score")
