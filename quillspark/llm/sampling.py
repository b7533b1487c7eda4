"""Bounded samples of labelled rows, drawn by a hash of doc_id: no sort, no window, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 30


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """True for rows no label is learnt from; a null doc_id is not held out."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(False))


def per_class(rows: DataFrame, label: str, most: int, seed: int) -> DataFrame:
    """About `most` rows of each label (all of them where there are fewer): each row is in if its hash is below its label's share."""
    share = rows.groupBy(F.col(label).alias("__label")).agg((SCALE * F.least(F.lit(1.0), most / F.count("*"))).cast("bigint").alias("__share"))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(SCALE))
    return rows.join(share, F.col(label) == F.col("__label")).where(drawn < F.col("__share")).drop("__label", "__share")


def _learnt(labels: DataFrame, label: str, modulus: int, rest: int) -> DataFrame:
    """(doc_id, label) of rows that may teach; a document with several labels counts with the largest."""
    learn = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
    return learn.groupBy("doc_id").agg((F.max(label).cast("int") == 1).cast("int").alias("label"))


def shares(labels: DataFrame, label: str, modulus: int, rest: int) -> dict[int, float]:
    """The share of labels 1 and of others among documents that may teach."""
    counts = {r.label: r["count"] for r in _learnt(labels, label, modulus, rest).groupBy("label").count().collect()}  # two rows at most
    return {k: n / sum(counts.values()) for k, n in counts.items()}


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, most: int, seed: int) -> DataFrame:
    """(label, text) of a sample of at most about `most` documents of each kind (label 1 or not), none of them held out.

    Of rows of documents that share a doc_id the least text counts, so the sample has at most one row for each id. The sample's
    ids, bounded by `most`, are broadcast.
    """
    chosen = per_class(_learnt(labels, label, modulus, rest), "label", most, seed)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
