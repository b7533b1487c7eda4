"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

The unit of training is the sentence: a text is cut after `.`, `!`, `?` before white space and at line ends, and a sentence is the
set of its words and of its pairs of neighbouring words (the last and first `SIDE` bytes of the two, with the blank). The kernel
compares two such strings, with a mark before and after each, by the ordered runs of three to five characters they share, gaps
allowed: each counts `DECAY` for each place skipped, so "idxiot", "i-d-i-o-t" and "i d i o t" stay near "idiot" (runs of single
letters and parts with one mark between are also read as one word). Strings are divided by a function of their length, which
keeps the kernel positive definite. A sentence is as toxic as its worst string, a text as its worst sentence.

Labels are on texts, so the worst string of a toxic text stands for it and is chosen anew in each round; in a clean text all
strings are clean and the worst come back as hard examples. The first choice comes from runs of five characters that toxic texts
hold more often than clean ones, so insults that share a stem and differ in the rest teach as well as those that recur; near
copies of a text count once. What recurs most also teaches by variants with a character inserted. Pairs are learnt from the toxic
texts whose words don't explain them; without such pairs their machine is zero and isn't run. Landmarks are strings that stand for
texts, disguises, common strings and clean ones last taken for toxic. A linear machine with squared hinge loss, in which examples
far on the wrong side (mislabelled texts) weigh less, is fitted to the Nystroem features. As features and kernel are linear in the
subsequences, a machine folds into one weight for each (hashed; 3 MB, whatever the corpus): scoring looks up every one of every
word of whole texts.

Where 0.5 lies is chosen by margins of texts that the machine wasn't fitted to (`FOLDS` machines, each fitted without a part of the
sample), weighted to the labels' natural shares; a text missed costs `MISS` times one wrongly taken.

Training is on at most about `SAMPLE` documents a label; of a text with more than `TEXT_STRINGS` distinct words or pairs those of
the smallest hashes teach. Each machine is one task on an executor; only weights and margins come to the driver. Cases: null and empty
texts score as texts without words; each input row gives one row; of rows that share a doc_id the least text teaches; extra columns
are ignored; without labels of both kinds all scores are 0.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .common import bound_batches, cut, kept
from .sampling import held_out, labelled_texts, shares

DECAY = 0.8
#: Places from each character of a subsequence to the next.
STEPS = ((1, 1), (1, 2), (2, 1), (1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 1, 1), (1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 2, 1), (1, 2, 1, 1), (2, 1, 1, 1))
_STEM = (1, 1, 1, 1)
FEATURES = 3 << 18
#: What a subsequence of so many characters weighs: longer ones tell more.
ORDER = {3: 0.2, 4: 1.0, 5: 3.0}
SIDE = 6
SAMPLE = 1200
TEXT_STRINGS = 20_000
LANDMARKS = 288
ROUNDS = 5
#: Strings whose runs mark toxic texts so much teach whatever else their text holds; the first FORMS of them also in disguise.
STRONG, FORMS = 8.0, 16
FOLDS = 3
MISS = 3.0
ALARMS = 0.02
DISGUISED = 0.3
MODULUS, REST = 5, 0
_CHUNK = 1 << 18
_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True
_WHITE = ~bt.SPACED


def _codes() -> np.ndarray:
    code = np.full(256, 63, np.int32)  # marks
    for b in range(256):
        if 97 <= b <= 122 or 65 <= b <= 90:
            code[b] = (b | 32) - 97
        elif 48 <= b <= 57:
            code[b] = 26 + b - 48
        elif b >= 0xC0:
            code[b] = 36
        elif b >= 0x80:
            code[b] = 37 + b % 26
    return code


CODE = _codes()


def way_weight(steps: tuple[int, ...]) -> float:
    return ORDER[len(steps) + 1] * DECAY ** (sum(steps) - len(steps))


def length_norm(n: np.ndarray) -> np.ndarray:
    """What a string of n bytes is divided by: the root of its subsequences' squared weights."""
    total = np.zeros(len(n))
    for steps in STEPS:
        total += np.maximum(n + 2 - sum(steps), 0) * way_weight(steps) ** 2
    return np.sqrt(np.maximum(total, 1.0))


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans end to end with a mark between: bytes, and the offset of each span and one past the last."""
    sizes = ends - starts + 1
    at = np.concatenate(([1], 1 + np.cumsum(sizes)))
    place = np.arange(at[-1] - 1) + np.repeat(starts - at[:-1] + 1, sizes)
    out = np.zeros(at[-1], np.uint8)
    out[1:] = data[np.minimum(place, len(data) - 1)] if len(data) else 0
    out[at - 1] = 0
    return out, at


class Strings:
    """Strings end to end in bytes, a mark before and after each, ready for the kernel."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.number = len(at) - 1
        self.starts, sizes = at[:-1], np.diff(at)
        self.norm = length_norm(sizes - 1)
        self.code = CODE[data]
        self.code[at - 1] = 63
        owner = np.repeat(np.arange(self.number, dtype=np.int32), sizes)
        self.head = np.concatenate((owner, [-1])).astype(np.int32)  # a mark begins the string after it
        self.tail = np.concatenate(([-2], owner)).astype(np.int32)  # and ends the one before it

    @classmethod
    def of(cls, words: list[bytes]) -> Strings:
        raw = b"\0" + b"".join([w + b"\0" for w in words])
        return cls(np.frombuffer(raw, np.uint8), np.cumsum([1, *(len(w) + 1 for w in words)]))

    def each(self, ways=STEPS):
        """(places, weight, feature, valid) of every way to step through the bytes."""
        code, n = self.code, len(self.code)
        for steps in ways:
            d = sum(steps)
            m = n - d
            if m <= 0:
                continue
            at = code[:m].copy()
            place = 0
            for s in steps:
                place += s
                at <<= 6
                at |= code[place : place + m]
            if len(steps) > 2:
                at = (at.view(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(14)).view(np.int32)
                at += (len(steps) - 2) << 18
            yield m, way_weight(steps), at, self.head[:m] == self.tail[d:]

    def values(self, weights: np.ndarray) -> np.ndarray:
        """For each string, the sum of `weights` over its subsequences, over the string's norm."""
        if not self.number:
            return np.empty(0)
        sums = np.zeros(len(self.code), np.float32)
        for m, decay, at, same in self.each():
            got = weights[at]
            got *= same
            got *= np.float32(decay)
            sums[:m] += got
        return np.add.reduceat(sums, self.starts - 1) / self.norm

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, feature, weight) of every subsequence, weights over the strings' norms."""
        found = [(self.head[:m][same], at[same], (decay / self.norm[self.head[:m][same]]).astype(np.float32)) for m, decay, at, same in self.each()]
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*found, strict=True)) or ((), (), ())))

    def stems(self) -> tuple[np.ndarray, np.ndarray]:
        """(string, five characters in a row) of every such run."""
        runs = np.zeros(len(self.code), np.int64)
        code = self.code.astype(np.int64)
        for _, _, _, same in self.each((_STEM,)):
            m = len(same)
            for k in range(5):
                runs[:m] = runs[:m] << 6 | code[k : k + m]
            return self.head[:m][same], runs[:m][same]
        return np.empty(0, np.int32), np.empty(0, np.int64)


def joined_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words written apart, put together: bytes, their bounds, and the number of each one's first word.

    Neighbours go together if one mark other than white space parts them, or if both are single characters at most three bytes
    apart.
    """
    none = np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, np.int64)
    if len(starts) < 2:
        return none
    gap = starts[1:] - ends[:-1]
    one = ends - starts <= 1
    join = ((gap == 1) & bt.SPACED[data[ends[:-1]]]) | (one[:-1] & one[1:] & (gap <= 3))
    edges = first[1:-1]
    join[edges[(edges > 0) & (edges < len(starts))] - 1] = False
    if not join.any():
        return none
    part = np.zeros(len(starts), bool)
    part[:-1] |= join
    part[1:] |= join
    head = part.copy()
    head[1:] &= ~join
    words = np.flatnonzero(part)
    sizes = (ends - starts)[words]
    place = np.repeat(starts[words] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    begin = np.concatenate(([0], np.cumsum(sizes)))
    heads = head[words]
    return data[place], np.append(begin[:-1][heads], begin[-1]), words[heads]


def neighbours(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbouring words of one sentence: bytes, offsets as `strings` gives them, and the number of each one's first word."""
    if len(starts) < 2:
        return np.zeros(1, np.uint8), np.ones(1, np.int64), np.empty(0, np.int64)
    stops = np.concatenate(([0], np.cumsum(_END[data])))
    lines = np.concatenate(([0], np.cumsum((data == 10) | (data == 13))))
    a, b = ends[:-1], starts[1:]
    whole = (lines[b] == lines[a]) & ~((stops[b] > stops[a]) & _WHITE[data[b - 1]])
    edges = first[1:-1]
    whole[edges[(edges > 0) & (edges < len(starts))] - 1] = False
    at = np.flatnonzero(whole)
    left = np.maximum(starts[at], ends[at] - SIDE)
    right = np.minimum(ends[at + 1], starts[at + 1] + SIDE)
    sides, bounds = strings(data, np.stack((left, starts[at + 1]), 1).ravel(), np.stack((ends[at], right), 1).ravel())
    return sides, bounds[::2], at


def document_margins(texts: pa.Array, words: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of a word, and of a pair, of each whole text, 0 at least."""
    out = np.zeros((2, len(texts)))
    for row, _, data, at in bt.chunks(texts, _CHUNK):
        starts, ends, first = bt.word_spans(data, at, bt.ALNUM)
        if not len(starts):
            continue
        rows = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        best = np.zeros((2, len(at) - 1))
        full = np.flatnonzero(np.diff(first) > 0)
        best[0, full] = np.maximum(np.maximum.reduceat(Strings(*strings(data, starts, ends)).values(words), first[full]), 0)
        flat, bounds, which = joined_runs(data, starts, ends, first)
        if len(which):
            np.maximum.at(best[0], rows[which], Strings(*strings(flat, bounds[:-1], bounds[1:])).values(words))
        if pairs is not None:
            sides, bounds, which = neighbours(data, starts, ends, first)
            np.maximum.at(best[1], rows[which], Strings(sides, bounds).values(pairs))
        out[:, row : row + best.shape[1]] = best
    return out[0], out[1]


def strings_of(texts: pa.Array) -> tuple[list[list[bytes]], list[list[bytes]]]:
    """Distinct words and distinct pairs of each text, A-Z lower-cased; words written apart also put together."""
    words: list[list[bytes]] = [[] for _ in range(len(texts))]
    pairs: list[list[bytes]] = [[] for _ in range(len(texts))]
    for row, _, data, at in bt.chunks(texts, _CHUNK):
        data = bt.LOWER_AT[data]
        starts, ends, first = bt.word_spans(data, at, bt.ALNUM)
        rows = np.searchsorted(first, np.arange(len(starts)), "right") - 1

        def cut(flat, a, b, owner):
            raw, sets = flat.tobytes(), [set() for _ in range(len(at) - 1)]
            for i, x, y in zip(owner.tolist(), a.tolist(), b.tolist(), strict=True):
                sets[i].add(raw[x:y])
            return sets

        flat, bounds, which = joined_runs(data, starts, ends, first)
        sides, edges, begun = neighbours(data, starts, ends, first)
        sides[sides == 0] = 32  # the blank within a pair
        for k, (w, j, p) in enumerate(zip(cut(data, starts, ends, rows), cut(flat, bounds[:-1], bounds[1:], rows[which]), cut(sides, edges[:-1], edges[1:] - 1, rows[begun]), strict=True)):
            words[row + k], pairs[row + k] = sorted(w | j), sorted(p)
    return words, pairs


def kernel(x: Strings, y: Strings) -> np.ndarray:
    """The kernel of every string of x with every one of y (y: landmarks)."""
    rows, feature, weight = x.features()
    order = np.argsort(rows, kind="stable")
    rows, feature, weight = rows[order], feature[order], weight[order]
    out = np.zeros((x.number, y.number), np.float32)
    marked, at, share = y.features()
    used, slot = np.unique(at, return_inverse=True)
    place = np.zeros(FEATURES, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    hit = np.flatnonzero(place[feature])
    for first in range(0, y.number, 64):  # the table of these strings' features is dense
        mine = (marked >= first) & (marked < first + 64)
        marks = np.zeros((len(used) + 1, min(64, y.number - first)), np.float32)
        np.add.at(marks, (slot[mine] + 1, marked[mine] - first), share[mine])
        for low in range(0, len(hit), 1 << 15):
            now = hit[low : low + (1 << 15)]
            heads = np.flatnonzero(np.diff(rows[now], prepend=-1))
            out[rows[now][heads], first : first + 64] += np.add.reduceat(marks[place[feature[now]]] * weight[now, None], heads, axis=0)
    return out


def _spread(words: list[bytes], n: int, near: float = 0.8) -> list[bytes]:
    """At most n of words, in their order, leaving out those near one already taken."""
    if not words:
        return []
    pool = Strings.of(words)
    gram = kernel(pool, pool)
    own = np.sqrt(np.maximum(np.diag(gram), 1e-12))
    gram /= own[:, None] * own[None, :]
    take: list[int] = []
    closest = np.full(len(words), -1.0)
    for i in range(len(words)):
        if len(take) < n and closest[i] < near:
            take.append(i)
            closest = np.maximum(closest, gram[:, i])
    return [words[i] for i in take]


def _disguised(word: bytes, rng: np.random.Generator, n: int = 32) -> list[bytes]:
    """n variants of word with a letter or digit inserted, for training on insults written so that no two texts agree."""
    if len(word) < 4:
        return []
    at = rng.integers(1, len(word), n)
    put = rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8), n)
    return [word[:i] + bytes([c]) + word[i:] for i, c in zip(at.tolist(), put.tolist(), strict=True)]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-6, steps: int = 25) -> np.ndarray:
    """Weighted squared hinge loss by Newton steps over the examples inside the margin; what is further than 1 on the wrong
    side counts linearly, so a few mislabelled examples can't turn the machine."""
    x = np.concatenate((z, np.ones((len(y), 1), z.dtype)), 1)
    weight = weight / weight.sum()
    ridge = np.diag(np.full(x.shape[1], reg))
    beta, inside, soft = np.zeros(x.shape[1]), np.ones(len(y), bool), np.ones(len(y))
    for _ in range(steps):
        near, share = x[inside].astype(np.float64), (weight * soft)[inside]
        beta = np.linalg.solve((near * share[:, None]).T @ near + ridge, near.T @ (share * y[inside]))
        slack = 1 - y * (x @ beta)
        now, was = slack > 0, soft
        soft = 1 / np.maximum(1, slack / 1.5)
        if (now == inside).all() and np.abs(soft - was).max() < 0.05:
            break
        inside = now
    return beta


class Sample:
    """Labelled texts as sets of strings: the distinct strings, and for each text the numbers of its own."""

    def __init__(self, bags: Iterable[tuple[int, bytes]], longest: int = 200, size: int = 10_000):
        number: dict[bytes, int] = {}
        labels, texts = [], []
        for label, lines in bags:
            labels.append(label)
            # a longer run stands by its first bytes here; scoring reads it whole
            texts.append(np.unique(np.array([number.setdefault(w[:longest], len(number)) for w in lines.split(b"\n")] if lines else [], np.int32)))
        self.number, self.label, self.texts, self.size = number, np.array(labels, np.int8), texts, size
        self.words = list(number)
        self.parts = [Strings.of(self.words[k : k + size]) for k in range(0, len(self.words), size)]

    def apart(self, hashes: int = 8, agree: int = 6) -> np.ndarray:
        """Numbers of the texts without near copies of earlier ones of their label, by the smallest of several hashes of their strings."""
        codes = np.fromiter((zlib.crc32(w) for w in self.words), np.uint64, len(self.words))
        least = np.stack([[int(h[t].min()) if len(t) else -1 - i for i, t in enumerate(self.texts)] for h in (bt.mix(codes + np.uint64(k << 32)) >> np.uint64(2) for k in range(1, hashes + 1))], 1) if self.texts else np.empty((0, hashes))
        keep: list[int] = []
        for label in (0, 1):
            mine = np.flatnonzero((self.label == 1) == bool(label))
            kept: list[int] = []
            for i in mine.tolist():
                if not kept or ((least[kept] == least[i]).sum(1) < agree).all():
                    kept.append(i)
            keep += kept
        return np.array(sorted(keep), np.int64)

    def values(self, weights: np.ndarray) -> np.ndarray:
        return np.concatenate([p.values(weights) for p in self.parts]) if self.parts else np.empty(0)

    def first_values(self, use: np.ndarray) -> np.ndarray:
        """How much each string's runs of five characters mark the toxic ones of the texts in `use`."""
        found = [p.stems() for p in self.parts]
        owner = np.concatenate([o + self.size * k for k, (o, _) in enumerate(found)]).astype(np.int32) if found else np.empty(0, np.int32)
        runs, stem = np.unique(np.concatenate([s for _, s in found]) if found else np.empty(0, np.int64), return_inverse=True)
        stem = stem.astype(np.int32)  # owners come in order
        at = np.searchsorted(owner, np.arange(len(self.words) + 1))
        up, down = np.zeros(len(runs)), np.zeros(len(runs))
        for i in use.tolist():
            mine = self.texts[i]
            sizes = at[mine + 1] - at[mine]
            place = np.repeat(at[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            (up if self.label[i] == 1 else down)[np.unique(stem[place])] += 1
        n1, n0 = (self.label[use] == 1).sum(), (self.label[use] != 1).sum()
        worth = np.log((up + 0.1) / (n1 + 1) / ((down + 0.5) / (n0 + 1))) * np.log1p(up) * (up > 2)
        out = np.zeros(len(self.words))
        np.maximum.at(out, owner, worth[stem])
        return out

    def strong(self, use: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Strings that mark toxic texts by themselves, the strongest first."""
        first = self.first_values(use) if first is None else first
        count = [np.bincount(np.concatenate([self.texts[i] for i in use if (self.label[i] == 1) == toxic] or [np.empty(0, np.int64)]), minlength=len(self.words)) for toxic in (True, False)]
        n1 = (self.label[use] == 1).sum()
        odds = np.log((count[0] + 0.1) / (n1 + 1) / ((count[1] + 0.5) / (len(use) - n1 + 1)))
        found = np.flatnonzero((first > STRONG) & (count[0] > 0) & (odds > 1))
        return found[np.argsort(-first[found], kind="stable")]

    def high(self, value: np.ndarray, use: np.ndarray) -> np.ndarray:
        return np.array([max(0.0, value[self.texts[i]].max()) if len(self.texts[i]) else 0.0 for i in use.tolist()])


def machine(sample: Sample, use: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, float, list[bytes], list[bytes]]:
    """Weights of subsequences and the shift fitted to the texts numbered in `use`, the landmarks, and the strings taught in disguise too."""
    rng = np.random.default_rng(seed)
    words, texts = sample.words, sample.texts
    toxic = [texts[i] for i in use if sample.label[i] == 1 and len(texts[i])]
    clean = [texts[i] for i in use if sample.label[i] != 1 and len(texts[i])]
    if not toxic or not clean:
        return np.zeros(FEATURES, np.float32), 0.0, [], []
    up, down = (np.bincount(np.concatenate(t), minlength=len(words)).astype(float) for t in (toxic, clean))
    every = np.flatnonzero(down)
    value = first = sample.first_values(use) - 0.02 * np.log1p(down)
    own = np.log((up + 0.1) / (len(toxic) + 1) / ((down + 0.5) / (len(clean) + 1)))
    strong = sample.strong(use, first)
    # landmarks: what stands for the most texts first, then other strong strings; near ones once
    worst, times = np.unique([t[np.argmax(first[t])] for t in toxic], return_counts=True)
    suspects = list(dict.fromkeys([*worst[np.argsort(-times, kind="stable")].tolist()[:600], *strong[:400].tolist()]))
    bad = _spread([words[i] for i in suspects], landmarks // 2)
    recurring = strong[np.argsort(-(own * np.log1p(up))[strong], kind="stable")][:400]
    often = set(_spread([words[i] for i in recurring], FORMS, 0.5))
    forms = {i: [v for v in _disguised(words[i], rng) if v not in sample.number] for i in recurring.tolist() if words[i] in often}
    bad += [v for vs in list(forms.values())[: landmarks // 4] for v in vs[:1]]
    plain = [words[i] for i in every[np.argsort(-down[every], kind="stable")][:400]]
    hard = set(rng.choice(every, min(len(every), 5000), replace=False).tolist())
    near: list[bytes] = []
    for turn in range(rounds):
        if turn < 2:  # landmarks settle once the first clean strings taken for toxic are known
            taken = set(bad)
            chosen = bad + _spread([w for w in dict.fromkeys(near + plain) if w not in taken], landmarks - len(bad))
            marks = Strings.of(chosen)
            gram = kernel(marks, marks)
            values, vectors = np.linalg.eigh((gram + gram.T).astype(np.float64) / 2)
            keep = values > 1e-5 * values[-1]
            root = vectors[:, keep] / np.sqrt(values[keep])
            rows, at, weight = marks.features()
            known: dict[bytes, np.ndarray] = {}
        # what stands for a text, strong strings and disguises weigh the same in all
        share: dict[bytes, float] = {}
        for i, n in zip(*np.unique([t[np.argmax(value[t])] for t in toxic], return_counts=True), strict=True):
            share[words[i]] = float(n) / len(toxic)
        for i in strong.tolist():
            share[words[i]] = share.get(words[i], 0.0) + up[i] / up[strong].sum()
        for i, variants in forms.items():
            for v in variants:
                share[v] = share.get(v, 0.0) + 1 / len(forms) / len(variants)
        ones, zeros = sorted(share), sorted(hard)
        new = [w for w in dict.fromkeys([*ones, *(words[i] for i in zeros)]) if w not in known]
        known |= dict(zip(new, kernel(Strings.of(new), marks) @ root.astype(np.float32), strict=True))
        z = np.stack([known[w] for w in ones] + [known[words[i]] for i in zeros])
        y = np.concatenate((np.ones(len(ones)), -np.ones(len(zeros))))
        weigh = np.concatenate(([share[w] for w in ones], np.sqrt(down[zeros])))
        weigh[: len(ones)] /= weigh[: len(ones)].sum()
        weigh[len(ones) :] /= 0.5 * weigh[len(ones) :].sum()
        beta = _svm(z, y, weigh)
        table = np.zeros(FEATURES)
        np.add.at(table, at, weight * (root @ beta[:-1])[rows])
        value = sample.values(table.astype(np.float32))
        if turn + 1 < rounds:
            found = every[np.argsort(-value[every], kind="stable")]
            hard |= {int(t[np.argmax(value[t])]) for t in clean} | set(found[:2000].tolist())
            near = [*dict.fromkeys([*(words[i] for i in found[:200]), *near])]
    return table.astype(np.float32), float(beta[-1]), chosen, [words[i] for i in forms]


def threshold(margin: np.ndarray, label: np.ndarray, share: float, forms: np.ndarray | None = None, miss: float = MISS) -> float:
    """Where toxic begins: least cost, labels at their natural shares, a miss `miss` times a false alarm, of which there are at most
    `ALARMS` of the clean texts. forms: margins of disguised insults, all of which together cost `DISGUISED` of what the toxic texts do."""
    forms = np.empty(0) if forms is None else forms
    y = label == 1
    m = np.concatenate((margin, forms))
    lost = np.concatenate((np.where(y, miss * share / max(1, y.sum()), 0), np.full(len(forms), DISGUISED * miss * share / max(1, len(forms)))))
    false = np.concatenate((np.where(y, 0, (1 - share) / max(1, (~y).sum())), np.zeros(len(forms))))
    order = np.argsort(m, kind="stable")
    m = m[order]
    missed = np.concatenate(([0.0], np.cumsum(lost[order])))
    alarms = np.concatenate((np.cumsum(false[order][::-1])[::-1], [0.0]))
    edges = np.concatenate(([m[0] - 0.1], (m[1:] + m[:-1]) / 2, [m[-1] + 0.1]))
    cost = np.where(alarms <= ALARMS * (1 - share) + 1e-12, missed + alarms, np.inf)
    fine = cost <= cost.min() + 1e-9
    low, high = edges[fine].min(), edges[fine].max()
    return float(low + 0.15 * (high - low))  # nothing lies between: nearer the clean texts


class Model:
    """Weights for words, where toxic begins, the same for pairs (None: no pairs are toxic), and the words' landmarks."""

    def __init__(self, words: np.ndarray, cut: float, pairs: np.ndarray | None = None, pair_cut: float = 0.0, landmarks: list[bytes] | None = None):
        self.words, self.cut, self.pairs, self.pair_cut, self.landmarks = words, cut, pairs, pair_cut, landmarks or []

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.words.any():
            return np.zeros(len(texts))
        words, pairs = document_margins(texts, self.words, self.pairs)
        over = words - self.cut
        if self.pairs is not None:
            over = np.maximum(over, pairs - self.pair_cut)
        return 1 / (1 + np.exp(-np.clip(2 * over, -500, 500)))


def part(bags: list[tuple[int, bytes, bytes]], fold: int) -> dict:
    """One machine's work on (label, words, pairs), each a line, of all texts of the sample: fitted without part `fold`, whose margins it gives, or,
    if fold is `FOLDS`, fitted to all of them."""
    bags = sorted(bags)
    sample = Sample((y, words) for y, words, _ in bags)
    use = sample.apart()
    if fold < FOLDS:
        mine = np.arange(len(use)) % FOLDS == fold
        table, shift, _, often = machine(sample, use[~mine])
        fresh = [v for w in often for v in _disguised(w, np.random.default_rng(101 + fold))]  # others than it was taught
        return {"forms": Strings.of(fresh).values(table), "form_shift": np.full(len(fresh), shift), "values": sample.high(sample.values(table), use[mine]), "shift": np.full(mine.sum(), shift), "labels": sample.label[use[mine]]}
    table, shift, landmarks, _ = machine(sample, use)
    out = {"words": table, "shift": shift, "landmarks": landmarks, "pairs": None, "pair_cut": 0.0}
    high = sample.high(sample.values(table), use)
    toxic = sample.label[use] == 1
    if not toxic.any() or toxic.all():
        return out
    unexplained = use[toxic & (high <= np.quantile(high[~toxic], 0.995))].tolist()
    if len(unexplained) < 3:
        return out
    paired = Sample((bags[i][0], bags[i][2]) for i in [*unexplained, *use[~toxic].tolist()])
    everyone = np.arange(len(paired.texts))
    strong = set(paired.strong(everyone).tolist())
    held = np.array([paired.label[i] != 1 or not strong.isdisjoint(paired.texts[i].tolist()) for i in everyone], bool)
    if strong and (paired.label[held] == 1).sum() > 2:
        out["pairs"], *_ = machine(paired, everyone[held])
        out["pair_cut"] = max(1e-3, threshold(paired.high(paired.values(out["pairs"]), everyone[held]), paired.label[held], 0.5))
    return out


def assembled(parts: list[dict], share: float) -> Model:
    """The model from the parts' results; share: of toxic texts among labelled ones."""
    full = next(p for p in parts if "words" in p)
    values, shift, labels, forms, form_shift = (np.concatenate([p[k] for p in parts if "values" in p]) for k in ("values", "shift", "labels", "forms", "form_shift"))
    where = 0.0
    if len(values):  # machines differ in scale and in shift: half way between what values and what shifted values say
        where = (threshold(values, labels, share, forms) + threshold(values + shift, labels, share, forms + form_shift) - full["shift"]) / 2
    return Model(full["words"], max(1e-3, where), full["pairs"], full["pair_cut"], full["landmarks"])


def fit(bags: list[tuple[int, list[bytes], list[bytes]]], share: float | None = None) -> Model:
    """Fits to (label, distinct words, distinct pairs) of labelled documents, all parts in this process."""
    bags = [(y, b"\n".join(words), b"\n".join(pairs)) for y, words, pairs in bags]
    share = share if share is not None else sum(y == 1 for y, *_ in bags) / max(1, len(bags))
    return assembled([part(bags, k) for k in range(FOLDS + 1)], share)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, modulus: int = MODULUS, rest: int = REST) -> Model:
    """Fits to a bounded sample of labelled documents, each part in a task of its own."""
    bound_batches(docs.sparkSession)
    sample = labelled_texts(docs, labels, "toxic", modulus, rest, most, 7)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def least(found: list[bytes]) -> bytes:
            return b"\n".join(found if len(found) <= TEXT_STRINGS else sorted(sorted(found, key=lambda w: (zlib.crc32(w), w))[:TEXT_STRINGS]))

        for batch in batches:
            words, pairs = strings_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([least(w) for w in words], pa.binary()), pa.array([least(p) for p in pairs], pa.binary())], names=["label", "words", "pairs"])

    read_once = cut(sample.mapInArrow(read, "label int, words binary, pairs binary"), "toxicity-sample", 8)
    # only the machine fitted to all texts looks at pairs
    dealt = read_once.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).withColumn("pairs", F.when(F.col("fold") == FOLDS, F.col("pairs")).otherwise(F.lit(b""))).repartitionByRange(FOLDS + 1, "fold")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity training", dict)
        found: dict[int, list] = {}
        for batch in batches:
            for y, words, pairs, fold in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found.setdefault(fold, []).append((y, words, pairs))
        for fold in sorted(found):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part(found.pop(fold), fold))], pa.binary())], names=["part"])

    parts = [pickle.loads(r.part) for r in dealt.mapInArrow(work, "part binary").collect()]  # FOLDS + 1 rows, some MB
    if not parts:
        return Model(np.zeros(FEATURES, np.float32), 0.0)
    return assembled(parts, shares(labels, "toxic", modulus, rest).get(1, 0.0))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (default: all), then __score and __predicted."""
    bound_batches(docs.sparkSession)
    names = keep if keep is not None else docs.columns
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 MB of weights, 6 with pairs, whatever the corpus
    source = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col("text").cast("string").alias("__text"))
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    schema = T.StructType([*fields, T.StructField("__score", T.DoubleType()), T.StructField("__predicted", T.IntegerType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("toxicity", token), lambda: shared.value)
        for batch in batches:
            p = model.scores(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return source.mapInArrow(each, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "__score", "__predicted")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))
