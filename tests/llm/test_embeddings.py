import math

import numpy as np

from quillspark.llm import embeddings as E


def brute(rows):
    ok = []
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.append((k, i, np.array(v, float), label))
    n = {k: 0 for k in range(len(rows))}
    name = [(r[0] is None, k if r[0] is None else r[0]) for k, r in enumerate(rows)]  # a row without an id is a node of its own, last
    root = {x: x for x in name}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for label in {o[3] for o in ok}:
        mine = [o for o in ok if o[3] == label]
        m = np.stack([o[2] for o in mine])
        norm = np.sqrt((m**2).sum(1))
        near = (m @ m.T) / (norm[:, None] * norm[None]) >= 0.98
        for a, b in zip(*np.nonzero(near), strict=True):
            if a != b:
                n[mine[a][0]] += 1
                x, y = sorted((find(name[mine[a][0]]), find(name[mine[b][0]])))
                root[y] = x
    least = [None if find(x)[0] else find(x)[1] for x in name]
    return sorted(((r[0], n[k], least[k], least[k] == r[0]) for k, r in enumerate(rows)), key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in E.near_vectors(df, **kw).collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = brute(rows)
    assert got(df) == want


def test_groups_blocks_and_copies(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 32))
    rows = []
    for i in range(700):
        c = base[0 if i % 3 == 0 else i % 6]
        rows.append((1000 - i, (c + rng.normal(size=32) * 0.12 * (1 + i % 2)).tolist(), i % 2))
    rows += [(2000 + i, (base[1] * (i + 1)).tolist(), 1) for i in range(30)] + [(3000 + i, base[2].tolist(), 0) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, name string")
    assert got(df, block=40) == brute(rows)


def test_cases(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, None, 1), (5, [0.0] * 4, 1), (6, [1.0, None, 1.0, 1.0], 1), (7, [1.0, math.nan, 1.0, 1.0], 1), (8, [math.inf, 1.0, 1.0, 1.0], 1), (9, v, None), (10, [2.0, 4.0, 6.0, 8.0], 1), (11, w, 1), (12, [], 1), (None, w, 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, label int, n bigint")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == [] and got(df.where("vec_id = 4")) == [(4, 0, 4, True)]
    twice = [(1, v, 1), (1, w, 1), (2, w, 1), (0, v, 1), (0, v, 1)]
    out = {r[0]: r[2] for r in got(spark.createDataFrame(twice, "vec_id bigint, embedding array<double>, label int"))}
    assert out == {0: 0, 1: 0, 2: 0}


def test_spanning_forest_joins_what_links_join():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m, k = (int(v) for v in rng.integers(1, 12, 3))
        i, j = rng.integers(0, n, k), rng.integers(0, m, k)

        def parts(edges):
            root = list(range(n + m))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in edges:
                root[find(a)] = find(n + b)
            return [[find(x) == find(y) for y in range(n + m)] for x in range(n + m)]

        edges = E.spanning(i, j, n, m)
        assert parts(edges) == parts(zip(i.tolist(), j.tolist(), strict=True)) and len(edges) <= n + m


def test_every_length_is_searched(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0, 5.0, 6.0]
    rows = [(1, v, 1), (2, [2 * x for x in v], 1), (3, v, 1), (4, w, 1), (5, [3 * x for x in w], 1), (6, w, 2), (7, [1.0], 1), (8, [2.0], 1), (9, [-1.0], 1), (10, v, 3), (10, w, 3), (11, w, 3)]
    out = sorted({r[:3] for r in got(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))})
    assert out == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6), (7, 1, 7), (8, 1, 7), (9, 0, 9), (10, 1, 10), (11, 1, 10)]
