"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton of all items reads the training words one by one and tracks the longest stretch that some item holds. A stretch
of `window` words (or a whole shorter item) is a hit; hits that touch or overlap make a span. Items are joined to nothing but
themselves, so no match runs over the end of an item.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Cases: a null or empty text has no words, no hits and comes
back as it is; a null item text has no words and no window; an item with a null id makes hits and spans
but stands in no list of items; items with equal texts each count; rows of the input stay one
output row each, repeated or not; columns of any name pass through (where one is called as the result is, the result gets
underscores more); an empty benchmark hits nothing.

Only words of the benchmark's own vocabulary can lead the automaton away from its root, so a vectorised look-up passes it just
the runs of such words that are long enough; the rest would reset it. The items travel in the function's closure. A table of
more than `block_words` words is cut into blocks that are read one after the other, each by its own automaton, so the automata's memory is
bounded whatever the benchmark's size. Then texts gather to `GATHER_BYTES` before the blocks are gone through, since building an
automaton takes seconds: benchmarks of some million words work, but cost a build a block for each such part of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .common import bound_batches

WINDOW = 10
BLOCK_WORDS = 1_000_000
GATHER_BYTES = 64 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of hashable words."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.whole: list[set] = []
        self.short: list[tuple] = []
        self.shortest = window

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _holding(self, state: int, length: int) -> int:
        """The state of the last `length` words of what `state` has read."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def seal(self, items: list[tuple[str, list]]) -> None:
        """Marks, for each state, the items whose windows end there; `items` are those that were added."""
        self.whole = [None] * len(self.next)
        ends: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            size = min(self.window, len(words))
            if not size:
                continue
            self.shortest = min(self.shortest, size)
            state = 0
            for i, word in enumerate(words, 1):
                state = self.next[state][word]
                if i >= size:
                    at = self._holding(state, size)
                    if size < self.window:
                        ends.setdefault(at, []).append((size, name))
                    else:
                        self.whole[at] = (self.whole[at] or set()) | {name}
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.short = [()] * len(self.next)
        for state in order[1:]:
            self.short[state] = self.short[self.link[state]] + tuple(ends.get(state, ()))
            if self.length[state] >= self.window and self.length[self.link[state]] >= self.window:
                self.whole[state] = self.whole[self.link[state]]

    def read(self, words: list) -> tuple[list[tuple[int, int]], set]:
        """Merged spans [start, end) of words inside windows that occur, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        state = length = 0
        for i, word in enumerate(words, 1):
            edges = self.next[state]
            while word not in edges and state:
                state = self.link[state]
                length = self.length[state]
                edges = self.next[state]
            if word in edges:
                state = edges[word]
                length += 1
            hit = 0
            if length >= self.window:
                hit = self.window
                found |= self.whole[state] or set()
            for size, name in self.short[state]:
                if size <= length:
                    hit = max(hit, size)
                    found.add(name)
            if hit:
                start = i - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, found - {None}


def item_words(text: str | None) -> list[bytes]:
    data = (text or "").encode().translate(bt.LOWER)
    flat = np.frombuffer(data, np.uint8)
    starts, ends, _ = bt.word_spans(flat, np.array([0, len(flat)]), bt.ALNUM)
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def blocks(items: list[tuple[str, str | None]], block_words: int = BLOCK_WORDS) -> list[list[tuple[str, list[bytes]]]]:
    out, used = [[]], 0
    for name, text in sorted(items, key=lambda x: (str(x[0]), x[1] or "")):
        words = item_words(text)
        if used and used + len(words) > block_words:
            out.append([])
            used = 0
        out[-1].append((None if name is None else str(name), words))
        used += len(words)
    return out


class Scanner:
    """The automaton of one block of items, with the vocabulary that keeps it away from words no item has."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.automaton = SuffixAutomaton(window)
        for _, words in items:
            self.automaton.add(words)
        self.automaton.seal(items)
        every = sorted({w for _, words in items for w in words})
        flat = np.frombuffer(b"".join(every), np.uint8)
        ends = np.cumsum([len(w) for w in every], dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if every else ends
        self.vocabulary = np.unique(bt.word_hashes(flat, starts, ends)) if every else np.empty(0, np.uint64)

    def scan(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list, set]]:
        """For each row: number of words, their place in bytes by span, spans of hit words, items."""
        starts, ends, first = bt.word_spans(data, at, bt.ALNUM)
        rows = len(at) - 1
        spans: list[list] = [[] for _ in range(rows)]
        found: list[set] = [set() for _ in range(rows)]
        least = self.automaton.shortest
        if len(starts) and len(self.vocabulary):
            hashes = bt.word_hashes(data, starts, ends)
            near = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[near] == hashes
            joined = known[:-1] & known[1:]
            edges = first[1:-1]
            joined[edges[(edges > 0) & (edges < len(known))] - 1] = False
            head, tail = known.copy(), known.copy()
            head[1:] &= ~joined
            tail[:-1] &= ~joined
            heads, tails = np.flatnonzero(head), np.flatnonzero(tail) + 1
            enough = tails - heads >= least
            raw = data.tobytes() if enough.any() else b""
            heads, tails = heads[enough], tails[enough]
            owners = np.searchsorted(first, heads, "right") - 1
            for row, a, b in zip(owners.tolist(), heads.tolist(), tails.tolist(), strict=True):
                words = [raw[starts[i] : ends[i]].translate(bt.LOWER) for i in range(a, b)]
                got, items = self.automaton.read(words)
                base = a - int(first[row])
                spans[row] += [(x + base, y + base, int(starts[a + x] - at[row]), int(ends[a + y - 1] - at[row])) for x, y in got]
                found[row] |= items
        return zip(np.diff(first).tolist(), range(rows), spans, found, strict=True)


def _merged(spans: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for a, b, x, y in sorted(spans):
        if out and out[-1][1] >= a:
            p = out.pop()
            a, x, b, y = p[0], p[2], max(b, p[1]), max(y, p[3])
        out.append((a, b, x, y))
    return out


class Matcher:
    """All blocks of a benchmark; builds each automaton when a worker first needs it and keeps one at a time if there are many."""

    def __init__(self, parts: list, window: int):
        self.parts, self.window, self.built = parts, window, {}

    def __getstate__(self):
        return {"parts": self.parts, "window": self.window, "built": {}}

    def scanner(self, k: int) -> Scanner:
        if k not in self.built:
            self.built.clear()
            self.built[k] = Scanner(self.parts[k], self.window)
        return self.built[k]

    def scan(self, texts: pa.Array) -> list[tuple[int, list, set]]:
        out: list = [None] * len(texts)
        for k in range(len(self.parts)):
            scanner = self.scanner(k)
            for row, end, data, at in bt.chunks(texts):
                for n, i, spans, found in scanner.scan(data, at):
                    old = out[row + i]
                    out[row + i] = (n, spans + (old[1] if old else []), found | (old[2] if old else set()))
        return [(n, _merged(spans), found) for n, spans, found in out]

    def clean(self, text: str, min_span: int) -> str:
        """text without its spans of `min_span` hit words or more, read again until none is left: ends that meet make no new hit."""
        while True:
            [(_, spans, _)] = self.scan(pa.array([text]))
            data, kept, last = text.encode(), [], 0
            for a, b, x, y in spans:
                if b - a >= min_span:
                    kept.append(data[last:x])
                    last = y
            if not kept:
                return text
            text = b"\n".join([*kept, data[last:]]).decode("utf-8", "replace")


def matcher(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, item: str = "item_id", text: str = "text") -> Matcher:
    """Reads the test items, a table that the size of the corpus doesn't change, and prepares their automata."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).toLocalIterator()
    return Matcher(blocks([(r.item, r.text) for r in rows], block_words), window)


MATCH = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("cleaned", T.StringType()),
    ]
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5, rewrite: bool = True, keep: list[str] | None = None, column: str = "match") -> DataFrame:
    """docs with one more column, `match`: words, hit words, items (sorted as strings), spans [first word, end word) and, if
    `rewrite`, the text without its spans of `min_span` words or more (length limit). `cleaned` is null where hit words exceed
    `max_coverage` of all words (coverage limit): such a document is to go whole. `keep` names the columns that pass through
    (default: all).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    found = matcher(benchmark, window)
    names = keep if keep is not None else docs.columns
    while column in names:
        column += "_"
    source = docs.select(*(F.col(f"`{c}`").alias(f"d_{i}") for i, c in enumerate(names)), F.col(f"`{text}`").cast("string").alias("__text"))
    passed = T.StructType([T.StructField(f"d_{i}", docs.schema[c].dataType) for i, c in enumerate(names)])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64()))), ("cleaned", pa.string())])

    def gathered(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(found.parts) == 1 or size >= GATHER_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    def each(batches):
        for batch in gathered(batches):
            texts = batch.column(len(names))
            rows = []
            for i, (n, spans, items) in enumerate(found.scan(texts)):
                hit = sum(b - a for a, b, _, _ in spans)
                cleaned = None
                if rewrite and hit <= max_coverage * n:
                    cleaned = texts[i].as_py()
                    if hit:
                        cleaned = found.clean(cleaned, min_span)
                rows.append({"n_words": n, "n_hit": hit, "n_items": len(items), "items": sorted(items), "spans": [[a, b] for a, b, _, _ in spans], "cleaned": cleaned})
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rows, kind)], names=[*passed.names, "match"])

    out = source.mapInArrow(each, T.StructType([*passed.fields, T.StructField("match", MATCH)]))
    return out.select(*(F.col(f"d_{i}").alias(c) for i, c in enumerate(names)), F.col("match").alias(column))


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of `decontaminate`: counts, the hash of the item list, and whether a document is contaminated."""
    out = decontaminate(docs, benchmark, rewrite=False, keep=["doc_id"])
    return out.select("doc_id", "match.n_words", "match.n_hit", "match.n_items", F.sha2(F.array_join("match.items", ","), 256).alias("items_sha256"), (F.col("match.n_hit") > 0).alias("contaminated"))


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
