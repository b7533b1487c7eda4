import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import mixing as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Targets by source: repeated sharing, written apart from the operator."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed, total = {s: 0.0 for s in order if not sizes[s]}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        unit = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * unit > 2 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * unit for s in rest}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def holds(rows, docs):
    size = Counter()
    for _, s, t in docs:
        size[s] += len(WORD.findall(t or ""))
    target = brute_targets(size)
    taken, longest, number, draws = Counter(), Counter(), Counter(), Counter()
    expect = sorted(((d, s, len(WORD.findall(t or ""))) for d, s, t in docs), key=str)
    assert sorted(((r.doc_id, r.source, r.size) for r in rows), key=str) == expect
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        number[r.source] += 1
        draws[r.source] += r.taken / r.size if r.size else 0
    for s in size:
        assert abs(taken[s] - target[s]) <= longest[s]
    return target, draws, number


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = X.verdicts(docs).collect()
    holds(got, rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, X.verdicts(docs.repartition(3)).collect()))


def test_blocks_balance_words_and_documents(spark):
    rng = np.random.default_rng(4)
    docs = [(i, "big" if i % 3 else f"s{i % 7}", "w " * int(rng.integers(1, 60))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    got = X.mix(df, ["doc_id", "source"], block=20).collect()
    words, copies, number = Counter(), Counter(), Counter()
    for r in got:
        words[r.source] += r.size * r.copies
        copies[r.source] += r.copies
        number[r.source] += 1
    for r in got:
        assert abs(words[r.source] - r.target) <= 60
        assert abs(copies[r.source] - r.target / r.source_size * number[r.source]) <= 2


CASES = [(1, None, "a b c"), (2, "a", None), (3, "a", ""), (4, "b", "x  y\tz\x0b q"), (4, "b", "x  y\tz\x0b q"), (None, "b", "one two"), (5, "empty", " \n"), (6, "c", "é " * 70_000), (7, "", "no name")]


def test_cases(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in CASES], "doc_id bigint, source string, text string, size int, target int")
    holds(X.verdicts(df).collect(), CASES)
    assert X.verdicts(df.limit(0)).collect() == []


def test_mixed_documents_follow_the_copies(spark):
    docs = [(i % 50, "st"[i % 2], "w " * (i % 9 + 1), i // 50) for i in range(120)] + [(7, None, "a", 1)] * 3
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, copies bigint")
    want = Counter()
    for r in X.mix(df, ["doc_id", "source"]).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    out = X.mixed_documents(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in out.collect())
    assert got == +want


def test_flight_keeps_totals_and_expectations():
    rng = np.random.default_rng(0)
    x = [int(v) for v in rng.integers(1, 100, 40)]
    p = [float(v) for v in rng.uniform(0, 1, 40)]
    sums = defaultdict(float)
    for seed in range(1500):
        q = X.flight(p, x, seed * 7919)
        open_ = [v for v in q if 0 < v < 1]
        assert len(open_) <= 2
        assert sum(q) == pytest.approx(sum(p), abs=1e-6) and np.dot(q, x) == pytest.approx(np.dot(p, x), abs=1e-4)
        for i, v in enumerate(q):
            sums[i] += v
    assert max(abs(sums[i] / 1500 - p[i]) for i in range(40)) < 0.06


def test_a_row_repeated_very_often_spreads_over_blocks(spark):
    rows = [(7, "one two three", "a")] * 3000 + [(i, "word " * (i % 9 + 1), "ab"[i % 2]) for i in range(100, 1100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = X.mix(df, ["doc_id", "source"], block=200)
    got = out.groupBy("source").agg({"target": "max", "copies": "sum", "size": "count"}).collect()
    assert sum(r["count(size)"] for r in got) == len(rows)
    for r in out.selectExpr("source", "target", "size * copies AS taken").groupBy("source").agg({"target": "max", "taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 9
