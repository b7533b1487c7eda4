"""Token-id store: ids of all documents end to end, their boundaries in Elias-Fano code.

`write_store` encodes every text, appends an end id and writes the ids in ascending doc_id order as blocks; `read_store` gives
documents back with their place in the whole sequence. A block is one self-describing binary image:

    magic  b"QTOK1\\n" | u32 size of the JSON header | header | parts

Header: documents, ids, ids of the shard before this block, bytes of an id (2 or 4), documents whose doc_id is null (they come
last), smallest doc_id, and for each part its length. Parts: the Elias-Fano code of the boundaries (one entry more than
documents, from 0), that of the doc_ids less the smallest, and the ids, little-endian. Spark's Parquet writer carries the images, one a row,
so its commit protocol holds for them on any store: a lost executor or a second attempt leaves no half block.

Shards are ranges of doc_id whose bounds come from quantiles of the ids, so a shard grows with the rows, not with the values.
Ids of a shard are counted as they are written; the manifest, one row a shard, turns that into places in the whole.

Cases: a null or empty text is one document of just the end id; rows with a null doc_id come after all others; rows with equal
doc_ids, repeated rows too, are documents of their own, ordered by their ids' bytes; other columns are not read; an empty
table makes a store of no blocks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, kept, let_go, shared_folder, trim

END_ID = 2
BLOCK_IDS = 1 << 20
#: A shard has about so many documents; a store of more than MOST_SHARDS times that has larger shards.
SHARD_DOCUMENTS, MOST_SHARDS = 1024, 20_000
MAGIC = b"QTOK1\n"
SAMPLE = 512
#: Pieces of text a Python worker remembers: some 400 bytes each. Fewer cost time (a quarter as many: a third more), not results.
REMEMBERED = 800_000
_BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence below 2**63 in about 2 + log2(bound / n) bits an entry.

    Low bits lie packed; high parts are unary in a bit array. Every 512th one bit's place is sampled in 32 bits, so `select`
    reads a few hundred bytes at most and no table of 64-bit offsets exists.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bound = int(values[-1]) if n else 0
        width = max(0, (bound // max(n, 1)).bit_length() - 1) if n else 0
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(places[-1]) + 1) if n else 0, np.uint8)
        bits[places] = 1
        low = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, width, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBII", self.n, self.width, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, low, high = struct.unpack_from("<QBII", data)
        at = struct.calcsize("<QBII")
        flat = np.frombuffer(data, np.uint8, offset=at)
        return cls(n, width, flat[:low], flat[low : low + high], np.frombuffer(data, "<u4", offset=at + low + high))

    def _low(self, i: int) -> int:
        out = 0
        for b in range(self.width):
            k = i * self.width + b
            out |= (int(self.low[k >> 3]) >> (k & 7) & 1) << b
        return out

    def select(self, i: int) -> int:
        """Entry i, from the sampled place at or before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = place >> 3, place & 7
        now = int(self.high[byte]) >> skip << skip
        while left >= (ones := int(_BITS[now])):
            left -= ones
            byte += 1
            now = int(self.high[byte])
        for _ in range(left):
            now &= now - 1
        place = (byte << 3) + (now & -now).bit_length() - 1
        return (place - i << self.width) | self._low(i)

    def decode(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.low, count=self.n * self.width, bitorder="little").reshape(self.n, self.width)
            out |= (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.astype(np.int64)


def pack_block(doc_ids: list[int | None], ids: list[bytes], id_bytes: int, before: int) -> bytes:
    """The image of a block; doc_ids ascend, nulls last."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    bounds = np.concatenate(([0], np.cumsum([len(x) // id_bytes for x in ids]))).astype(np.int64)
    parts = [EliasFano.encode(bounds).to_bytes(), EliasFano.encode(known.astype(np.uint64) - np.uint64(least % (1 << 64))).to_bytes(), b"".join(ids)]
    head = json.dumps({"documents": len(ids), "ids": int(bounds[-1]), "before": before, "id_bytes": id_bytes, "nulls": len(ids) - len(known), "least": least, "parts": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class Block:
    """A block read back; documents by number, their bounds from `select` or all at once."""

    def __init__(self, image: bytes):
        if image[: len(MAGIC)] != MAGIC:
            raise ValueError("not a block of a token store")
        (size,) = struct.unpack_from("<I", image, len(MAGIC))
        at = len(MAGIC) + 4
        self.head = json.loads(image[at : at + size])
        cuts = np.cumsum([at + size, *self.head["parts"]]).tolist()
        bounds, docs, ids = (image[a:b] for a, b in pairwise(cuts))
        self.bounds, self._docs = EliasFano.from_bytes(bounds), EliasFano.from_bytes(docs)
        self.ids = np.frombuffer(ids, f"<u{self.head['id_bytes']}")

    def doc_ids(self) -> list[int | None]:
        known = self._docs.decode().astype(np.uint64) + np.uint64(self.head["least"] % (1 << 64))
        return [*known.astype(np.int64).tolist(), *[None] * self.head["nulls"]]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class _Codes(dict):
    """Numbers pieces as they are first met; the numbers are shared by all pieces of one encoder."""

    def __init__(self, owner: PieceEncoder, lead: str):
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> int:
        new = self.owner.new
        code = self[piece] = self.owner.coded + len(new)
        new.append(self.lead + piece)
        return code


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, each distinct piece once.

    Such a tokenizer never joins what stands before a single space between two non-spaces with what stands from it on, so a
    text's ids are those of its pieces, cut there, in turn. Pieces met for the first time go to the library many at a time, end
    to end; the bytes that each id stands for tell them apart again. `keep` bounds how many pieces are remembered.
    """

    SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
    CUT = re.compile(r"(?<=\S) (?=\S)")
    LETTERS = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

    def __init__(self, path: str, end_id: int = END_ID, keep: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for pieces that are a space and letters, where cutting at the space is all that the file's own rules do
        self.letters = Tokenizer.from_file(path)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
        plain = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.bytes_of = np.array([len(t.encode()) if t in plain else len(t) for t in (self.tokenizer.id_to_token(i) or "" for i in range(size))], np.int64)
        self.end_id, self.keep = end_id, keep
        self._forget()

    def _forget(self) -> None:
        self.new: list[str] = []
        self.heads, self.tails = _Codes(self, ""), _Codes(self, " ")
        self.pool, self.used = np.array([self.end_id] * 1024, self.kind), 1
        self.at, self.sizes, self.uses = np.zeros(1024, np.int32), np.ones(1024, np.int32), np.zeros(1024, np.int32)
        self.coded, self.letters_kept = 1, 0  # code 0: the end id

    def pieces(self, text: str) -> list[str]:
        """Pieces of text, each without the space before it."""
        beside = [c for c in self.SPACES if c in text]
        if text[:1].isspace() or text[-1:].isspace() or "  " in text or any(f" {c}" in text or f"{c} " in text for c in beside):
            return self.CUT.split(text)
        return text.split(" ")

    def _learn(self) -> None:
        """Has the library encode what is new: pieces that begin with their only space go end to end, others alone."""
        pieces, self.new = self.new, []
        if not pieces:
            return
        n = len(pieces)
        self.letters_kept += sum(map(len, pieces))
        if self.coded + n > len(self.at):
            self.at, self.sizes, self.uses = (np.concatenate((x, np.zeros(self.coded + n, np.int32))) for x in (self.at, self.sizes, self.uses))
        alone, mixed, plain = [], [], []
        for i, p in enumerate(pieces):
            (plain if self.LETTERS(p) else alone if p[0:1] != " " or p[1:2].isspace() or p[-1:].isspace() else mixed).append(i)
        for tokenizer, rest in ((self.letters, plain), (self.tokenizer, mixed)):
            groups = [rest[k : k + 128] for k in range(0, len(rest), 128)]
            got = tokenizer.encode_batch_fast(["".join([pieces[i] for i in g]) for g in groups], add_special_tokens=False)
            ids = np.array([i for x in got for i in x.ids], self.kind)
            reach = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(pieces[i].encode()) for i in rest])
            cuts = np.searchsorted(reach, ends, "right")
            if len(rest) and (cuts[-1] != len(ids) or (cuts == 0).any() or (reach[cuts - 1] != ends).any()):
                alone += rest  # a tokenizer that joins pieces after all
                continue
            self._keep(np.array(rest, np.int64) + self.coded, np.diff(cuts, prepend=0), ids)
        got = [x.ids for x in self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)]
        self._keep(np.array(alone, np.int64) + self.coded, np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], self.kind))
        self.coded += n

    def _keep(self, codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        end = self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(end, self.kind)))
        self.pool[self.used : end] = ids
        self.sizes[codes] = sizes
        self.at[codes] = self.used + np.cumsum(sizes) - sizes
        self.used = end

    def _forget_rare(self) -> None:
        """Drops the pieces that were met once; all, if that leaves too many."""
        old, uses, at, sizes, pool = (self.heads, self.tails), self.uses, self.at, self.sizes, self.pool
        again = uses[1 : self.coded] > 1
        if again.sum() > self.keep // 2 or sizes[1 : self.coded][again].sum() > 4 * self.keep or self.letters_kept > 128 * self.keep:
            uses = np.zeros_like(uses)
        self._forget()
        for known, now in zip(old, (self.heads, self.tails), strict=True):
            codes = np.fromiter(known.values(), np.int64, len(known))
            stay = uses[codes] > 1
            codes = codes[stay]
            m = self.coded + len(codes)
            now.update(zip(compress(known, stay.tolist()), range(self.coded, m), strict=True))
            self.letters_kept += sum(map(len, now))
            known.clear()
            if m > len(self.at):
                self.at, self.sizes, self.uses = (np.concatenate((x, np.zeros(m, np.int32))) for x in (self.at, self.sizes, self.uses))
            n = sizes[codes].astype(np.int64)
            place = np.repeat(at[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())  # cumsum counts in 64 bits
            self._keep(np.arange(self.coded, m), n, pool[place])
            self.coded = m

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, the end id after each, and their bounds."""
        if self.coded > self.keep or self.used > 8 * self.keep or self.letters_kept > 64 * self.keep:
            self._forget_rare()
        codes: list[int] = []
        bounds = [0]
        for text in texts:
            pieces = self.pieces(text)
            codes.append(self.heads[pieces[0]])
            codes += map(self.tails.__getitem__, pieces[1:])
            codes.append(0)
            bounds.append(len(codes))
        self._learn()
        code = np.array(codes, np.int64)
        self.uses[: self.coded] += np.bincount(code, minlength=self.coded).astype(np.int32)
        sizes = self.sizes[code]
        ends = np.cumsum(sizes, dtype=np.int64)
        out = self.pool[np.repeat(self.at[code] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate(([0], ends))[bounds]


def encoder(path: str, end_id: int = END_ID, keep: int = REMEMBERED) -> PieceEncoder:
    """This process's encoder for a tokenizer file; a Python worker keeps it from task to task."""
    return kept(("encoder", path, end_id, keep), lambda: PieceEncoder(path, end_id, keep))


def encode_documents(docs: DataFrame, tokenizer_path: str, bounds: list[int], end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id", keep: int = REMEMBERED) -> DataFrame:
    """Rows (shard, doc_id, ids): ids with the end id as packed little-endian integers; shard by `bounds` of doc_id, nulls last.

    A bound that comes several times is an id of very many rows: these, and rows without an id, are dealt over several shards by
    the first bytes of their ids, so shards go by (doc_id, ids) all the same.
    """
    bound_batches(docs.sparkSession)
    edges, times = np.unique(np.array(bounds, np.int64), return_counts=True)
    times = np.where(times > 1, times, 0)
    base = np.concatenate(([0], np.cumsum(1 + np.concatenate(([0], times)))))  # first shard of each interval; the last: of nulls
    lone = max(1, len(bounds) // 4)

    def dealt(ids: np.ndarray, null: np.ndarray, lead: np.ndarray) -> np.ndarray:
        at = np.searchsorted(edges, ids, "right")
        parts = np.concatenate(([0], times))[at]
        hot = (parts > 0) & (edges[np.maximum(at - 1, 0)] == ids) if len(edges) else np.zeros(len(ids), bool)
        return np.where(null, base[-1] + (lead * lone >> 16), base[at] + np.where(hot, lead * parts >> 16, parts)).astype(np.int32)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, end_id, keep)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column(0)
                got, bounds = coder.encode([t or "" for t in part.column(1).to_pylist()])
                lead = got[bounds[:-1]].astype(np.int64) & 0xFFFF  # a document has its end id at least
                lead = (lead & 0xFF) << 8 | lead >> 8  # as bytes compare
                shard = dealt(ids.fill_null(0).to_numpy(False), ids.is_null().to_numpy(False), lead)
                packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((bounds * got.itemsize).astype(np.int32)), pa.py_buffer(got)])
                yield pa.RecordBatch.from_arrays([pa.array(shard), ids, packed], names=["shard", "doc_id", "ids"])
            trim()  # after each batch: more often costs a tenth of the time

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(each, "shard int, doc_id bigint, ids binary")


def _bounds(docs: DataFrame, doc_id: str, shards: int) -> list[int]:
    got = docs.select(F.percentile_approx(F.col(f"`{doc_id}`").cast("bigint"), [k / shards for k in range(1, shards)], max(10_000, 20 * shards))).first()[0] if shards > 1 else None
    return sorted(got or [])


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shards: int | None = None, block_ids: int = BLOCK_IDS, text: str = "text", doc_id: str = "doc_id", keep: int = REMEMBERED) -> None:
    """Writes blocks to `path`/blocks and the manifest (shard, documents, ids, start) to `path`/manifest.

    Texts are encoded where they are read; only packed ids are shuffled, once, to their shards.
    """
    spark = docs.sparkSession
    if shards is None:
        shards = min(MOST_SHARDS, max(1, docs.count() // SHARD_DOCUMENTS))
    id_bytes = int(encoder(tokenizer_path, end_id, keep).kind[-1])
    encoded = encode_documents(docs, tokenizer_path, _bounds(docs, doc_id, shards), end_id, text, doc_id, keep)
    placed = encoded.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # the encoder, which has no work until another table's texts come
        shard, number, before = None, 0, 0
        names: list = []
        ids: list[bytes] = []
        size = 0

        def flush():
            nonlocal number, before, size
            image = pack_block(names, ids, id_bytes, before)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([image], pa.binary())], names=["shard", "block", "documents", "ids", "image"])
            number, before, size = number + 1, before + size, 0
            names.clear()
            ids.clear()
            return row

        for batch in batches:
            for s, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (s != shard or size >= block_ids):
                    yield flush()
                if s != shard:
                    shard, number, before = s, 0, 0
                names.append(d)
                ids.append(x)
                size += len(x) // id_bytes
        if ids:
            yield flush()

    placed.mapInArrow(each, "shard int, block int, documents bigint, ids bigint, image binary").write.parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids")).orderBy("shard").collect()
    start, rows = 0, []
    for r in totals:  # one row a shard: bounded by the parameter `shards`
        rows.append((r.shard, r.documents, r.ids, start))
        start += r.ids
    spark.createDataFrame(rows, "shard int, documents bigint, ids bigint, start bigint").coalesce(1).write.parquet(f"{path}/manifest")


def read_blocks(spark: SparkSession, path: str, schema: str, digest: Callable[[Block, int], dict]) -> DataFrame:
    """Runs `digest` over each block and its start in the whole; yields its columns."""
    starts = {r.shard: r.start for r in spark.read.parquet(f"{path}/manifest").collect()}
    bound_batches(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(image.as_py())
                yield pa.RecordBatch.from_pydict(digest(block, starts[shard] + block.head["before"]))

    return spark.read.parquet(f"{path}/blocks").select("shard", "image").mapInArrow(each, schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids before it), ids."""

    def digest(block: Block, start: int) -> dict:
        bounds = block.bounds.decode()
        ids = block.ids.astype(np.int32)
        return {"doc_id": pa.array(block.doc_ids(), pa.int64()), "start": pa.array(bounds[:-1] + start), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))}

    return read_blocks(spark, path, "doc_id bigint, start bigint, ids array<int>", digest)


def placed_documents(spark: SparkSession, path: str) -> DataFrame:
    """The contract's digest of a store: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""

    def digest(block: Block, start: int) -> dict:
        bounds = block.bounds.decode()
        raw = block.ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairwise(bounds.tolist())]
        return {"doc_id": pa.array(block.doc_ids(), pa.int64()), "start": pa.array(bounds[:-1] + start), "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": pa.array(crc, pa.int64())}

    return read_blocks(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", digest)


def store_and_read(docs: DataFrame, tokenizer_path: str, path: str | None = None, keep: int = REMEMBERED) -> DataFrame:
    """Writes docs as a store (by default under the shared folder) and gives `placed_documents` of it. keep: pieces a worker remembers."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/quillspark/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer_path, keep=keep)
    return placed_documents(spark, path)
