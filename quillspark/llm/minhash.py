"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit integers make the whole signature: one places a shingle's hash on a ring, the other, shifted
round the ring by 0, 1, 2, ... places, gives each coordinate its order. Coordinates go to bands; documents that agree in a
band are candidates; a link stands only if the full shingle sets confirm it:

    100 * |A and B| >= 75 * |A or B|      words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, shingles of 5 words

160 coordinates in 32 bands of 5 miss a pair at exactly 0.75 once in 6,000 and lose none above 0.85 in practice.

How groups stay linear. Documents with the same word sequence form a class and only the class's smallest id goes on. In a
bucket every document is tied to the bucket's smallest id, not to all others; the components of these ties are clusters, and
any two documents that share a bucket share a cluster. Each text then goes to its cluster once. There an index of shingles
finds all links from one central document, then from each document that has not joined the central one's group by its turn, so
every pair across groups is looked at. No bucket and no cluster has a cap and no candidate is dropped; a cluster too large for a
task is cut in blocks, each pair of which is a task.

Cases: null, empty and blank texts have an empty set and link with nothing; a text of fewer than five words has its whole
sequence as one shingle; rows with a null doc_id link with nothing and count as kept; rows that share a doc_id are one
document with several texts, linked through any of them; extra columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import bound_batches, components, cut, few

WORDS = 5
BANDS, ROWS = 32, 5
#: What one block of a cluster may hold, about.
BLOCK_DOCS, BLOCK_BYTES = 1024, 8 << 20
_BLOCK = 1 << 15


def _mix32(h: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def signatures(shingles: np.ndarray, at: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """A row of `coordinates` 32-bit minima for each run [at[i], at[i + 1]); an empty run has all ones.

    Coordinate k of a set is the smallest value of the second permutation over the set's ring places moved by k.
    """
    rows = len(at) - 1
    out = np.full((rows, coordinates), 0xFFFFFFFF, np.uint32)
    ring = _mix32((shingles >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    for low in range(0, len(ring), _BLOCK):
        part = ring[low : low + _BLOCK]
        first = int(np.searchsorted(at, low, "right")) - 1
        last = int(np.searchsorted(at, low + len(part), "left"))
        starts = np.maximum(at[first:last], low) - low
        full = np.flatnonzero(np.diff(np.append(starts, len(part))) > 0)
        starts, owner = starts[full], first + full
        work = np.empty_like(part)
        for k in range(coordinates):
            np.add(part, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), out=work)
            best = np.minimum.reduceat(_mix32(work), starts)
            out[owner, k] = np.minimum(out[owner, k], best)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each row, the band's number mixed in."""
    rows = signature.shape[1] // bands
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands))
    for r in range(rows):
        keys = bt.mix(keys * bt.U(bt.BASE) + signature[:, r::rows][:, :bands].astype(np.uint64))
    return keys


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, shingle hashes, first shingle of each row) of whole texts."""
    for row, _, data, at in bt.chunks(texts):
        starts, ends, first = bt.word_spans(data, at, bt.SPACED)
        hashes, where = bt.shingle_hashes(bt.word_hashes(data, starts, ends), first, WORDS)
        yield row, data, at, hashes, where


def profiles(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, fp (digest of the word sequence; null without words), bands, n_bytes."""
    bound_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at, hashes, where in shingle_sets(batch.column(1)):
                n = len(at) - 1
                sizes = np.zeros(n, np.int64)
                prints: list[bytes | None] = [None] * n
                raw = data.tobytes().translate(bt.LOWER)
                for i in range(n):
                    if where[i + 1] > where[i]:
                        sizes[i] = len(np.unique(hashes[where[i] : where[i + 1]]))
                        prints[i] = hashlib.blake2b(b" ".join(raw[at[i] : at[i + 1]].split()), digest_size=16).digest()
                signature = signatures(hashes, where)
                keys = band_keys(signature).view(np.int64)
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), np.ascontiguousarray(keys).ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(sizes), pa.array(prints, pa.binary()), bands, pa.array(np.diff(at))], names=["doc_id", "n_shingles", "fp", "bands", "n_bytes"])

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(each, "doc_id bigint, n_shingles bigint, fp binary, bands array<bigint>, n_bytes bigint")


def links_among(ids: np.ndarray, texts: pa.Array, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Confirmed links that join all documents joined by any confirmed link between them.

    block: 0 or 1 for each document; if both occur, only pairs across them count (the others are looked at elsewhere).
    """
    n = len(ids)
    sets: list[np.ndarray] = []
    for _, _, at, hashes, where in shingle_sets(texts):
        sets += [np.unique(hashes[where[i] : where[i + 1]]) for i in range(len(at) - 1)]
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    _, term = np.unique(flat, return_inverse=True)
    counts = np.bincount(term) if len(term) else np.zeros(0, np.int64)
    begin = np.concatenate(([0], np.cumsum(counts)))
    holders = owner[np.argsort(term, kind="stable")]
    reach = np.concatenate(([0], np.cumsum(sizes)))
    group = np.arange(n)
    found: list[tuple[int, int]] = []
    across = block is not None and len(np.unique(block)) > 1

    def look(i: int) -> None:
        mine = term[reach[i] : reach[i + 1]]
        spans = counts[mine]
        place = np.repeat(begin[mine] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        common = np.bincount(holders[place], minlength=n)
        near = (100 * common >= 75 * (sizes[i] + sizes - common)) & (common > 0) & (group != group[i])
        if across:
            near &= block != block[i]
        for j in np.flatnonzero(near).tolist():
            if group[j] != group[i]:
                found.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]

    if n < 2:
        return found
    central = np.bincount(owner, weights=counts[term], minlength=n) / np.maximum(sizes, 1)
    order = np.argsort(-central, kind="stable").tolist()
    for i in order:  # what has joined the first document's group is never left behind: the other end of its pairs is looked at
        if i == order[0] or group[i] != group[order[0]]:
            look(i)
    return found


def confirmed(clusters: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) with 100 * intersection >= 75 * union within clusters (doc_id, cluster, n_bytes) that keep their components."""
    bound_batches(clusters.sparkSession)
    sizes = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    spread = clusters.join(sizes, "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = spread.select("doc_id", "cluster", "own", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"))
    rows = tiles.join(texts, "doc_id")

    def each(rows: pa.Table) -> pa.Table:
        blocks = rows.column("own").to_numpy()
        pairs = links_among(rows.column("doc_id").to_numpy(), rows.column("text"), (blocks != blocks.min()).astype(np.int8))
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return rows.groupBy("cluster", "row", "col").applyInArrow(each, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id is that)."""
    base = cut(profiles(docs, text, doc_id), "minhash-profiles")
    named = base.where("doc_id is not null and fp is not null")
    classes = named.groupBy("fp").agg(F.min("doc_id").alias("least"))
    copies = named.select("doc_id", "fp").join(classes, "fp").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    nodes = named.join(classes.select(F.col("fp").alias("__fp"), F.col("least").alias("doc_id")), "doc_id").where("fp = __fp")

    rows = nodes.select("doc_id", F.explode("bands").alias("key"))
    heads = rows.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("top")).where("head < top").select("key", "head")
    ties = rows.join(heads, "key").where("doc_id > head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    clusters = components(ties, "minhash-clusters").withColumnRenamed("root", "cluster")
    members = clusters.join(base.groupBy(F.col("doc_id").alias("node")).agg(F.max("n_bytes").alias("n_bytes")), "node").withColumnRenamed("node", "doc_id")
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id is not null")
    known = components(confirmed(members, source).union(copies), "minhash-links")
    out = few(base.select("doc_id", "n_shingles").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left"))
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True)).alias("kept"))
