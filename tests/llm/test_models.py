import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import langid, quality


def rest(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def prose(rnd, n=60):
    return " ".join("".join(rnd.choice(["ta", "re", "on", "mi", "el", "su"]) for _ in range(rnd.randrange(1, 4))) for _ in range(n)) + "."


def junk(rnd, n=60):
    kind = rnd.randrange(3)
    words = prose(rnd, n).split()
    if kind == 0:
        return " ".join(w for w in words[:6] for _ in range(10))
    if kind == 1:
        return " ".join(w + rnd.choice(["%%%", "###", "&&&"]) for w in words)
    return " | ".join(words)


@pytest.fixture(scope="module")
def labelled():
    rnd = random.Random(4)
    return [(i, junk(rnd) if i % 4 == 0 else prose(rnd), int(i % 4 != 0)) for i in range(600)]


ODD = [(5001, None), (5002, ""), (5003, "  "), (None, "some text"), (5004, "ta re on " * 60_000), (5004, "ta re on")]


def test_quality_on_held_out_rows_and_cases(spark, labelled):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in labelled] + [(i, t, None, None) for i, t in ODD], "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(None, 1), (5001, None)], "doc_id bigint, quality int")
    got = quality.verdicts(docs, labels).collect()
    again = quality.verdicts(docs, labels).collect()
    assert got == again and len(got) == len(labelled) + len(ODD)
    truth = {i: y for i, _, y in labelled}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and rest(r.doc_id, 4) == 2)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_quality_ignores_held_out_labels(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id bigint, text string")
    fair = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id bigint, quality int")
    turned = spark.createDataFrame([(i, 1 - y if rest(i, 4) == 2 else y) for i, _, y in labelled], "doc_id bigint, quality int")
    assert quality.verdicts(docs, fair).collect() == quality.verdicts(docs, turned).collect()


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in quality.verdicts(docs, labels).collect()] == [0.5, 0.5] and quality.verdicts(docs.limit(0), labels).collect() == []


def test_quality_scores_equal_the_average_written_out():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.3)
    texts = ["one two two", "", "é", "a b c " * 5000]
    buckets, counts = quality.bags(pa.array(texts))
    want = [1 / (1 + np.exp(-((model.parts[b] * c).sum() / max(c.sum(), 1) + 0.3))) for b, c in zip(buckets, counts, strict=True)]
    assert np.allclose(model.scores(pa.array(texts)), want, atol=1e-5)


def tongue(rnd, lang, n=40):
    parts = {"aa": ["the", "ing", "tion", "er"], "bb": ["ung", "sch", "ein", "ü"], "cc": ["ción", "que", "los", "ñ"]}[lang]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_language_on_held_out_rows_and_cases(spark):
    rnd = random.Random(6)
    rows = [(i, tongue(rnd, ["aa", "bb", "cc"][i % 3]), ["aa", "bb", "cc"][i % 3]) for i in range(300)]
    odd = [(901, None, "aa"), (902, "", "aa"), (903, "12 345 !?", "bb"), (904, "schein", None), (None, "schung", None), (905, tongue(rnd, "cc", 60_000), "cc"), (905, "the", "aa")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows + odd], "doc_id bigint, text string, lang string, source string, bucket int")
    got = langid.verdicts(docs).collect()
    assert len(got) == len(rows) + len(odd) and got == langid.verdicts(docs).collect()
    by = {}
    for r in got:
        assert r.lang_pred in ("aa", "bb", "cc", "und") and 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and rest(r.doc_id, 4) == 2)
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert by[901] == by[902] == by[903] == ["und"] and by[904] == by[None] == ["bb"] and sorted(by[905]) == ["aa", "cc"]
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert np.mean([r.lang_pred == ["aa", "bb", "cc"][r.doc_id % 3] for r in held]) > 0.98


def test_language_without_any(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.verdicts(docs).collect()] == [("und", 0.0)]


def test_language_scores_equal_counts_written_out():
    rng = np.random.default_rng(1)
    model = langid.Model(["x", "y"], rng.normal(size=(2, 1 << langid.BITS)), np.log([0.4, 0.6]))
    for t in ("Abc, déf", "a", "word " * 3000):
        total, n = np.zeros(2), 0
        data = np.frombuffer(t.encode(), np.uint8)
        for order in langid.ORDERS:
            for i in range(len(data) - order + 1):
                gram = data[i : i + order]
                if (langid.LETTERS[gram] != 32).any():
                    total += model.table[:, langid.ngram_buckets(gram, order, langid.BITS, langid.LETTERS)[0]]
                    n += 1
        total += model.prior
        p = np.exp((total - total.max()) / np.sqrt(max(n, 1)))
        names, score = model.predict(pa.array([t]))
        assert names[0] == ["x", "y"][total.argmax()] and np.isclose(score[0], p.max() / p.sum(), atol=1e-4)


def test_held_out_accuracy_on_the_fixtures(spark):
    """Held-out rows of sf0.1: floors, not targets."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.verdicts(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 900 and np.mean([r.predicted == r.quality for r in rows]) > 0.98
    rows = langid.verdicts(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").collect()
    assert len(rows) > 2000 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.99
