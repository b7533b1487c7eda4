import random
import re

import numpy as np

from quillspark.llm import bytetext as bt
from quillspark.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    post = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            near = {j for g in s for j in post.get(g, ())}
            for j in near:
                e, r = sets[j]
                if 100 * len(s & r) >= 75 * len(s | r):
                    a, b = sorted((find(d), find(e)))
                    root[b] = a
            for g in s:
                post.setdefault(g, []).append(i)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def got(df):
    return sorted((tuple(r) for r in M.near_duplicates(df).collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(not r[3] for r in expected)
    assert got(docs) == expected


def test_cases_chains_and_groups(spark):
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "a b c d e f"), (8, "A b c d e f"), (8, "A b c d e f"), (60, "x " * 50_000), (61, "x x x x x x")]
    rows += [(100 + i, " ".join(base[:i] + [f"e{i}"] + base[i + 1 :])) for i in range(40)]
    chain = list(base)
    for i in range(30):
        rows.append((300 - i, " ".join(chain)))
        chain[(i * 4) % 120] = f"c{i}"
    rows.append((40, "é É è. z q"))
    df = spark.createDataFrame([(d, t, 0, None) for d, t in rows], "doc_id bigint, text string, n_shingles int, root string")
    assert got(df) == brute(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_coordinates_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.75):
        rates = []
        for _ in range(60):
            both, rest = int(200 * share), (200 - int(200 * share)) // 2
            pool = bt.mix(rng.integers(0, 1 << 62, 200).astype(np.uint64))
            a, b = pool[: both + rest], np.concatenate((pool[:both], pool[both + rest :]))
            s = M.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            rates.append((s[0] == s[1]).mean())
        assert abs(np.mean(rates) - share) < 0.02


def test_signature_does_not_depend_on_blocks():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 62, 100_000).astype(np.uint64)
    at = np.array([0, 0, 10, 70_000, 70_000, 100_000])
    whole = M.signatures(x, at)
    for i in range(5):
        assert (whole[i] == M.signatures(x[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))[0]).all()
