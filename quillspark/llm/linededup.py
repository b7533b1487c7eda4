"""Line dedup by content-defined chunks of lines and by repeated passages.

A text's lines are grouped in chunks whose bounds depend on the lines alone: a chunk ends after a line if a rolling hash over it
and the line before is 0 modulo `DIVISOR`, and a line of `LONG_WORDS` words or more is a chunk of its own. A chunk of several
lines, or of one long line, that occurs more than once in all documents is kept where it occurs first, by (doc_id, digest of the
text, place), and removed elsewhere.

A short passage in foreign surroundings seldom holds a whole chunk. With `passage_words`, as the query runs, every run of whole
lines with more words than that goes too where it isn't the first copy, however long its lines are: each line begins and ends
the shortest such passage, whatever lies around it, and these passages are counted like chunks; together they cover any
repeated run. Where a passage overlaps its own first copy in one text, the lines of that copy stay.

Chunks and passages are counted by a 128-bit hash of their lines' digests, by an aggregate with partial sums, so one that a third
of all documents share is no hot key. Then bytes are compared: under one hash all occurrences must have the same digests, and
under one digest the same line (deflated, which equal bytes alone have in common). Should two share a hash, the whole is done
again with another seed.

Cases: a null text stays null and has 0 lines, an empty one has one empty line; chunks of nothing but blank lines stay; rows
with equal id and text are one document with several rows, all cleaned alike; rows with a null doc_id come last in the order;
columns of any name pass through (where one is called `lines`, the result is `lines_`); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut

DIVISOR = 3
LONG_WORDS = 40
PASSAGE_WORDS = 50
HASH_BYTES = 16
LINE_BYTES = 16


def line_chunks(text: str, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> list[tuple[int, int, str, bool]]:
    """(first line, end line, chunk, whether it counts) of a text."""
    lines = text.split("\n")
    bounds, last = [0], 0
    for i, line in enumerate(lines):
        own = len(line) >= 2 * long_words - 1 and len(line.split()) >= long_words
        h = int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little")
        if own:
            if bounds[-1] != i:
                bounds.append(i)
            bounds.append(i + 1)
        elif ((last * 0x9E3779B97F4A7C15 + h) % (1 << 64) >> 20) % divisor == 0:
            bounds.append(i + 1)
        last = h
    if bounds[-1] != len(lines):
        bounds.append(len(lines))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        chunk = "\n".join(lines[a:b])
        out.append((a, b, chunk, bool(chunk.strip()) and (b - a > 1 or len(chunk.split()) >= long_words)))
    return out


def passages(words: list[int], limit: int) -> set[tuple[int, int]]:
    """(first line, end line) of the shortest passages of over `limit` words; words: their number in each line.

    From each line the shortest one that begins with it, and the shortest one that ends with it; blank lines stand inside only.
    Whether lines make a passage depends on these lines alone. Any stretch of over `limit` words is made up of such passages.
    """
    full = [i for i, n in enumerate(words) if n]
    out, at, total = set(), 0, 0
    for i in full:
        while at < len(full) and total <= limit:
            total += words[full[at]]
            at += 1
        if total <= limit:
            break
        out.add((i, full[at - 1] + 1))
        total -= words[i]
    at = total = 0
    for i in full:
        total += words[i]
        while total - words[full[at]] > limit:
            total -= words[full[at]]
            at += 1
        if total > limit:
            out.add((full[at], i + 1))
    return out


def units(text: str, seed: int, size: int, limit: int | None) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
    """Digests of the lines, and (first line, end line, hash) of each chunk that counts and of each passage of over `limit` words."""
    salt = seed.to_bytes(8, "little")
    lines = text.split("\n")
    digests = [hashlib.blake2b(line.encode(), digest_size=LINE_BYTES, salt=salt).digest() for line in lines]
    found = {(a, b) for a, b, _, counts in line_chunks(text) if counts}
    if limit is not None:
        found |= passages([len(line.split()) for line in lines], limit)
    return digests, [(a, b, hashlib.blake2b(b"".join(digests[a:b]), digest_size=size, salt=salt).digest()) for a, b in sorted(found)]


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.withColumn("__id", F.col(f"`{doc_id}`").cast("bigint")).withColumn("__text", F.col(f"`{text}`").cast("string")).withColumn("__tie", F.xxhash64("__text"))


def repeated_units(docs: DataFrame, text: str, doc_id: str, seed: int, size: int, limit: int | None) -> DataFrame:
    """(id, tie, marks): for each document with repeated chunks or passages the lines of each and those of them to remove, from `drop` on."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, places, ends, hashes = [], [], [], [], []
            for i, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, h in units(x, seed, size, limit)[1]:
                    ids.append(i)
                    ties.append(t)
                    places.append(a)
                    ends.append(b)
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(places, pa.int32()), pa.array(ends, pa.int32()), pa.array(hashes, pa.binary())], names=["id", "tie", "place", "end", "hash"])

    read = _keyed(docs, text, doc_id).where("__text is not null").select("__id", "__tie", "__text")
    found = cut(read.mapInArrow(each, "id bigint, tie bigint, place int, end int, hash binary"), "lines-chunks")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "tie", "place", "end")
    first = found.groupBy("hash").agg(F.count("*").alias("n"), F.min(order).alias("kept")).where("n > 1")
    # where a passage overlaps its own first copy, what the two share stays
    same = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("tie") == F.col("kept.tie"))
    drop = F.when(same, F.least(F.col("end"), F.greatest(F.col("place"), F.col("kept.end")))).otherwise(F.col("place"))
    met = found.join(first, "hash").withColumn("drop", drop)
    return met.groupBy("id", "tie").agg(F.collect_set(F.struct("place", "end", "drop")).alias("marks"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash_bytes: int = HASH_BYTES, seed: int = 0, passage_words: int | None = None) -> DataFrame:
    """docs with one more column, `lines`: number of lines, lines removed, words removed, and the text that stays.

    passage_words: besides repeated chunks, repeated runs of lines of over so many words go, wherever they stand; None: chunks only.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    names = docs.columns
    marks = repeated_units(docs, text, doc_id, seed, hash_bytes, passage_words)
    # the text travels once: it is one of the columns that pass through
    at = names.index(text)
    keyed = _keyed(docs, text, doc_id).select(*(F.col(f"`{c}`").alias(f"d_{i}") for i, c in enumerate(names)), "__id", "__tie")
    joined = keyed.join(marks, F.col("__id").eqNullSafe(F.col("id")) & F.col("__tie").eqNullSafe(F.col("tie")), "left").select(*(f"d_{i}" for i in range(len(names))), "marks")
    ready = cut(joined, "lines-marked")
    own = F.col(f"d_{at}").cast("string").alias("__text")

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bodies = [], []
            for x, marked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                met = {(m["place"], m["end"]) for m in marked}
                digests, found = units(x, seed, hash_bytes, passage_words)
                used: set[int] = set()
                for a, b, h in found:
                    if (a, b) in met:
                        hashes.append(b"u" + h)
                        bodies.append(b"".join(digests[a:b]))
                        used.update(range(a, b))
                lines = x.split("\n")
                for d, line in {digests[i]: lines[i] for i in sorted(used)}.items():
                    hashes.append(b"l" + d)
                    bodies.append(zlib.compress(line.encode(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(bodies, pa.binary())], names=["hash", "body"])

    seen = ready.where("marks is not null").select(own, "marks").mapInArrow(texts_of, "hash binary, body binary")
    if not seen.groupBy("hash").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").isEmpty():
        return dedup_lines(docs, text, doc_id, HASH_BYTES, seed + 1, passage_words)

    result = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("words_removed", T.LongType()), T.StructField("text", T.StringType())])
    kind = pa.struct([("n_lines", pa.int64()), ("n_removed", pa.int64()), ("words_removed", pa.int64()), ("text", pa.string())])
    passed = T.StructType([T.StructField(f"d_{i}", docs.schema[c].dataType) for i, c in enumerate(names)])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, marked in zip(batch.column(at).cast(pa.string()).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                drop = {i for m in marked or () for i in range(m["drop"], m["end"])}
                if x is None or not drop:
                    out.append({"n_lines": 0 if x is None else x.count("\n") + 1, "n_removed": 0, "words_removed": 0, "text": x})
                    continue
                lines = x.split("\n")
                out.append({"n_lines": len(lines), "n_removed": len(drop), "words_removed": sum(len(lines[i].split()) for i in drop), "text": "\n".join(line for i, line in enumerate(lines) if i not in drop)})
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, kind)], names=[*(f"d_{i}" for i in range(len(names))), "lines"])

    done = ready.mapInArrow(clean, T.StructType([*passed.fields, T.StructField("lines", result)]))
    column = "lines"
    while column in names:
        column += "_"
    return done.select(*(F.col(f"d_{i}").alias(c) for i, c in enumerate(names)), F.col("lines").alias(column))


def verdicts(docs: DataFrame, passage_words: int | None = None) -> DataFrame:
    """doc_id, lines, lines and words removed, md5 of the text that stays, and that text."""
    out = dedup_lines(docs.select("doc_id", "text"), passage_words=passage_words)
    return out.select("doc_id", "lines.n_lines", "lines.n_removed", "lines.words_removed", F.md5(F.col("lines.text").cast("binary")).alias("text_md5"), F.col("lines.text").alias("text"))
