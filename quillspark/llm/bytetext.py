"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

Texts of a batch lie end to end in one byte buffer, so words, hashes and n-grams of thousands of documents come from a few
numpy passes without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20


def _spaces() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def _alnum() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[0x80:] = True
    for span in (b"09", b"az", b"AZ"):
        inside[span[0] : span[1] + 1] = True
    return inside


#: True for bytes of words that white space ends: [^\x20\x09-\x0D]+
SPACED = _spaces()
#: True for bytes of words of letters, digits and all beyond ASCII, A-Z counting as a-z: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = _alnum()
#: A-Z to a-z
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_AT = np.frombuffer(LOWER, np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
FOLDED_CODE = BYTE_CODE[LOWER_AT]
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 8 * CHUNK:
            _powers[kind] = have
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), at


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of whole rows, about `limit` bytes at a time; a longer row comes alone."""
    data, at = buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    within = inside[data]
    joined = within[:-1] & within[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    joined[edges - 1] = False
    first, last = within.copy(), within
    first[1:] &= ~joined
    last[:-1] &= ~joined
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def prefix(data: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial of the bytes; with `span_hash` they give the hash of any span in O(1)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * _power("up", BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _power("down", INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = FOLDED_CODE) -> np.ndarray:
    """64-bit hashes of words; FOLDED_CODE takes A-Z as a-z."""
    return span_hash(prefix(data, code), starts, ends)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each row and the index of each row's first shingle; fewer words, but not none, make one."""
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(at[-1], np.uint64)
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            rolled = mix(rolled * U(BASE) + words[j : len(words) - k + 1 + j])
        whole = np.repeat(counts >= k, sizes)
        place = np.arange(at[-1]) - np.repeat(at[:-1], sizes) + np.repeat(first[:-1], sizes)
        out[whole] = rolled[place[whole]]
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        h = np.full(1, counts[row], np.uint64)
        for w in words[first[row] : first[row + 1]]:
            h = mix(h * U(BASE) + w)
        out[at[row]] = h[0]
    return out, at
