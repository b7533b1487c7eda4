import hashlib
import re

from quillspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def same(rows, expected):
    key = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted((tuple(r) for r in rows), key=key) == sorted(expected, key=key)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = D.verdicts(docs, bench).collect()
    assert any(r.contaminated for r in got)
    same(got, brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]))


LONG = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, LONG), (2, LONG), (3, "Short ITEM"), (4, None), (5, "..."), (6, "é"), (10, "a a a a a a a a a a a a"), (7, "three four five six seven eight nine ten eleven twelve thirteen")]
DOCS = [
    (1, None), (2, ""), (3, " ... "), (4, LONG.upper()), (5, f"x {LONG} y " * 400), (6, "short item short; item é"), (7, "a " * 30), (8, "two three four five six seven eight nine ten"),
    (4, LONG.upper()), (None, "é short"), (9, f"{LONG} thirteen"), (11, "one two three four five six seven eight nine ten short item"),
]


def test_small_cases_and_blocks(spark):
    docs = spark.createDataFrame([(i, t, "en", 1, "m") for i, t in DOCS], "doc_id bigint, text string, lang string, n_words bigint, match string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    expected = brute(DOCS, ITEMS)
    same(D.verdicts(docs, bench).collect(), expected)
    import pyarrow as pa

    for size in (1, 5, 20, 1000):
        m = D.Matcher(D.blocks(ITEMS, size), 10)
        got = m.scan(pa.array([t for _, t in DOCS], pa.string()))
        assert [(n, sum(b - a for a, b, *_ in s), len(f)) for n, s, f in got] == [e[1:4] for e in expected]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert D.verdicts(docs, bench).collect() == []
    some = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    assert not any(r.contaminated for r in D.verdicts(some, bench.limit(0)).collect())


def test_removal_takes_spans_and_heavy_documents(spark):
    bench = spark.createDataFrame(ITEMS[:1], "item_id bigint, text string")
    pad = "clean words here " * 10
    docs = spark.createDataFrame([(1, f"{pad}{LONG} {pad}"), (2, LONG), (3, pad), (4, None), (5, f"{pad} one two three four five {LONG} six seven eight nine ten eleven twelve {pad}")], "doc_id bigint, text string")
    got = {r.doc_id: r.match for r in D.decontaminate(docs, bench).collect()}
    assert words(got[1].cleaned) == words(pad + pad) and got[1].spans == [[30, 42]]
    assert got[2].cleaned is None
    assert got[3].cleaned == pad and got[4].cleaned is None and got[4].n_words == 0
    assert brute([(5, got[5].cleaned)], ITEMS[:1])[0][2] == 0


def test_items_without_an_id_hit_but_are_not_listed(spark):
    bench = spark.createDataFrame([(None, LONG), (3, "Short ITEM"), (None, "lone")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"x {LONG} y"), (2, "a short item"), (3, "lone z z"), (4, "none")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256 == hashlib.sha256((b"3" if r.doc_id == 2 else b"")).hexdigest(), r.contaminated) for r in D.verdicts(docs, bench).collect()}
    assert got == {1: (12, 0, True, True), 2: (2, 1, True, True), 3: (1, 0, True, True), 4: (0, 0, True, False)}
    assert {r.doc_id: r.match.cleaned for r in D.decontaminate(docs, bench).collect()}[3] == "\n z z"
