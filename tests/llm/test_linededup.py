import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import linededup as D


def tie(spark, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()]


def brute(spark, rows):
    """Keeps the first of each chunk by a plain walk over all documents in order."""
    ties = tie(spark, [t for _, t in rows])
    order = sorted({(d is None, d or 0, k, t) for (d, t), k in zip(rows, ties, strict=True) if t is not None})
    seen, out = set(), {}
    for none, d, k, t in order:
        kept, removed, words = [], 0, 0
        for a, b, chunk, counts in D.line_chunks(t):
            if counts and chunk in seen:
                removed += b - a
                words += len(chunk.split())
            else:
                kept.append(chunk)
                if counts:
                    seen.add(chunk)
        out[None if none else d, t] = (t.count("\n") + 1, removed, words, "\n".join(kept))
    return sorted(((d, *(out[d, t] if t is not None else (0, 0, 0, None))) for d, t in rows), key=str)


def got(df, **kw):
    return sorted(((r.doc_id, r.lines.n_lines, r.lines.n_removed, r.lines.words_removed, r.lines.text) for r in D.dedup_lines(df, **kw).collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(spark, rows)
    assert got(docs) == want and any(r[2] for r in want)
    digests = {r.doc_id: r.text_md5 for r in D.verdicts(docs).collect()}
    assert digests == {r[0]: hashlib.md5(r[4].encode()).hexdigest() for r in want}


PASSAGE = " ".join(f"word{i}" for i in range(55))
BLOCK = "\n".join(f"short line number {i}" for i in range(40))
CASES = [
    (3, f"before\n{PASSAGE}\nafter"), (2, f"other\nlines\n{PASSAGE}"), (1, PASSAGE), (5, None), (6, ""), (7, "\n\n\n"), (8, "\n\n\n"), (9, "one line"), (10, "one line"), (None, f"x\n{PASSAGE}"),
    (11, f"a\nb\nc\n{BLOCK}\nd"), (12, f"quite different\n{BLOCK}\nend\nof text"), (13, f"{PASSAGE}\n{PASSAGE}"), (14, "twice\n" + PASSAGE), (14, "twice\n" + PASSAGE), (15, "long\n" * 30_000),
]


def test_cases(spark):
    df = spark.createDataFrame([(d, t, 1, "m") for d, t in CASES], "doc_id bigint, text string, place int, marks string")
    want = brute(spark, CASES)
    assert got(df) == want
    by = {r[0]: r for r in want}
    assert by[1][2] == 0 and all(PASSAGE not in by[i][4] for i in (2, 3, 13, 14, None))
    assert by[12][2] > 20 and got(df.limit(0)) == []


def test_colliding_hashes_are_found(spark):
    df = spark.createDataFrame([(d, t) for d, t in CASES] + [(100 + i, f"{PASSAGE} {i}") for i in range(400)], "doc_id bigint, text string")
    assert got(df, hash_bytes=1) == got(df)


def test_bounds_resist_shifts():
    whole = [f"line {i} of some text" for i in range(200)]
    one = {c for _, _, c, _ in D.line_chunks("\n".join(whole))}
    two = {c for _, _, c, _ in D.line_chunks("\n".join(["new first line", *whole]))}
    assert len(one & two) >= len(one) - 2


@pytest.mark.parametrize("text", ["", "a", "a\n", "\n", f"{PASSAGE}\n\n{PASSAGE}"])
def test_chunks_make_up_the_text(text):
    assert "\n".join(c for _, _, c, _ in D.line_chunks(text)) == text


def split_passage(rnd, n_lines, n_words):
    words = [f"p{rnd.randrange(10**9)}" for _ in range(n_words)]
    at = [0, *sorted(rnd.sample(range(1, n_words), n_lines - 1)), n_words]
    return [" ".join(words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def foreign(rnd, n):
    return [f"f{rnd.randrange(10**9)} of its own" for _ in range(n)]


def test_passages_of_short_lines_go_whatever_surrounds_them(spark):
    rnd = random.Random(4)
    docs, want = [], {}
    for k in range(60):
        lines = split_passage(rnd, 2 + k % 5, rnd.randrange(51, 101))
        one, two = foreign(rnd, rnd.randrange(4)), foreign(rnd, rnd.randrange(1, 4))
        end = foreign(rnd, rnd.randrange(3))
        docs += [(2 * k, "\n".join([*one, *lines, *foreign(rnd, 2)])), (2 * k + 1, "\n".join([*two, *lines, *end]))]
        want[2 * k], want[2 * k + 1] = docs[-2][1], "\n".join([*two, *end])
    few = split_passage(rnd, 2, 50)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in D.verdicts(df, D.PASSAGE_WORDS).collect()} == want
    assert D.passages([len(x.split()) for x in few], D.PASSAGE_WORDS) == set()


def test_whole_block_goes_and_overlapping_copies_keep_the_first(spark):
    rows = [(1, f"a\nb\nc\n{BLOCK}\nd"), (2, f"quite different\n{BLOCK}\nend\nof text"), (3, "\n".join(f"row {i % 2}" for i in range(200)))]
    got = {r.doc_id: r for r in D.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string"), D.PASSAGE_WORDS).collect()}
    assert got[2].n_removed > 30 and got[2].text == "quite different\nend\nof text" and got[2].n_removed == 40 and got[2].words_removed == 160
    assert got[1].n_removed == 0 and got[3].text.split("\n")[:26] == [f"row {i % 2}" for i in range(26)]


def test_registered_query_takes_passages(spark, tmp_path):
    from quillspark.llm.registry import QUERIES

    lines = split_passage(random.Random(1), 3, 60)
    rows = [(1, "\n".join(["x", *lines])), (2, "\n".join(["quite", "other", *lines, "end"]))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()} == {1: rows[0][1], 2: "quite\nother\nend"}


def test_passages_cover_every_repeated_run():
    rnd = random.Random(2)
    for _ in range(300):
        words = [rnd.choice((0, 0, 1, 5, 20, 60)) for _ in range(rnd.randrange(1, 30))]
        whole = D.passages(words, 50)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                inside = {i for x, y in whole if a <= x and y <= b for i in range(x, y)}
                full = {i for i in range(a, b) if words[i]}
                assert (full <= inside) if sum(words[a:b]) > 50 else not inside
