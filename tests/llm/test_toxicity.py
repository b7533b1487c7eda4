import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import toxicity as X

BAD = ["blorgat", "snarvik", "fuzdemon"]
SYLLABLES = ["ta", "re", "on", "mi", "el", "su", "da", "no"]


def sentence(rnd, n=12):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def corpus(n=300, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = sentence(rnd).split()
        toxic = i % 3 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(BAD)
        out.append((i, " ".join(words) + ". " + sentence(rnd), int(toxic)))
    return out


def bags(texts):
    words, pairs = X.strings_of(pa.array([t for _, t, _ in texts]))
    return list(zip([y for *_, y in texts], words, pairs, strict=True))


@pytest.fixture(scope="module")
def model():
    return X.fit(bags(corpus(1200)))


def test_finds_insults_plain_and_disguised(model):
    rnd = random.Random(9)
    clean = [sentence(rnd, 40) for _ in range(200)]
    assert (model.scores(pa.array(clean)) < 0.5).all()
    for w in BAD:
        spaced, dotted = " ".join(w), ".".join(w)
        texts = [f"{c} {x} {c}" for c, x in zip(clean, (w, w.upper(), spaced, dotted, f"{w}."), strict=False)]
        assert (model.scores(pa.array(texts)) >= 0.5).all()


def test_fast_values_equal_the_kernel_written_out(model):
    words = [b"snarvik", b"ta", b"x", b"remion", b"q" * 70, "ñandú".encode(), b"tal remi"]

    def features(word):
        code = [63, *(int(X.CODE[b]) for b in word), 63]
        out = {}
        for steps in X.STEPS:
            for i in range(len(code) - sum(steps)):
                at, key = i, [code[i]]
                for s in steps:
                    at += s
                    key.append(code[at])
                out[tuple(key)] = out.get(tuple(key), 0) + X.ORDER[len(steps) + 1] * X.DECAY ** (sum(steps) - len(steps))
        return out

    norm = [X.length_norm(np.array([len(w)]))[0] for w in words]
    each = [features(w) for w in words]
    expected = [[sum(v * fb.get(k, 0) for k, v in fa.items()) / (na * nb) for fb, nb in zip(each, norm, strict=True)] for fa, na in zip(each, norm, strict=True)]
    got = X.kernel(X.Strings.of(words), X.Strings.of(words))
    assert np.allclose(got, expected, atol=1e-3)
    assert np.linalg.eigvalsh(got).min() > -1e-3
    whole = X.document_margins(pa.array(["x ta snarvik remion"]), model.words)[0][0]
    assert np.isclose(whole, max(0, X.Strings.of([b"x", b"ta", b"snarvik", b"remion"]).values(model.words).max()), atol=1e-4)


def test_strings_of_a_text():
    words, pairs = X.strings_of(pa.array(["One two. Three\nfour i.d.i.o.t", None, "", "a b c"]))
    assert words[0] == [b"d", b"four", b"i", b"idiot", b"o", b"one", b"t", b"three", b"two"] and words[1] == words[2] == []
    assert b"one two" in pairs[0] and b"two three" not in pairs[0] and b"three four" not in pairs[0] and b"four i" in pairs[0]
    assert words[3] == [b"a", b"abc", b"b", b"c"] and pairs[3] == [b"a b", b"b c"]


def test_insults_of_two_ordinary_words():
    """Both words stand in clean texts as well; only side by side, in one sentence, are they an insult."""
    rnd, rows = random.Random(31), []
    for i in range(600):
        words = sentence(rnd, 30).split()
        k = rnd.randrange(28)
        if i % 3 == 0:
            words[k : k + 2] = ["remita", "dasuel"]
        else:
            words[k], words[(k + 9) % 30] = "remita", "dasuel"
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    model = X.fit(bags(rows))
    assert model.pairs is not None
    clean = [sentence(rnd, 20) for _ in range(100)]
    assert (model.scores(pa.array([f"{c} remita dasuel {c}" for c in clean])) >= 0.5).all()
    assert (model.scores(pa.array([f"dasuel {c} remita" for c in clean] + [f"{c} remita. Dasuel {c}" for c in clean])) < 0.5).mean() > 0.95


def test_mislabelled_texts_do_not_turn_the_machine():
    rnd = random.Random(8)
    rows = [(i, t, 1 - y if rnd.random() < 0.05 else y) for i, t, y in corpus(900, 12)]
    model = X.fit(bags(rows))
    new = corpus(300, 77)
    got = model.scores(pa.array([t for _, t, _ in new])) >= 0.5
    assert np.mean(got == np.array([y == 1 for *_, y in new])) > 0.97


def test_held_out_rows_of_the_fixtures(spark):
    """sf0.1: about one English toxic label in fourteen stands on a text without any insult, which bounds what can be caught."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = X.verdicts(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 90 and len(clean) > 700
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.03


def test_query_on_held_out_rows_and_cases(spark):
    rows = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, "en", 1.0) for i, t, _ in rows] + [(1000, None, None, None), (1001, "", None, None), (1002, "...", None, None), (None, BAD[0], None, None), (1003, "ta re " * 60_000 + BAD[1], None, None), (1003, "ta re", None, None)], "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, None), (None, 1)], "doc_id bigint, toxic int")
    got = X.verdicts(docs, labels).collect()
    assert len(got) == docs.count() and got == X.verdicts(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.predicted)
    assert by[1000] == by[1001] == by[1002] == [0] and sorted(by[1003]) == [0, 1] and by[None] == [1]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text here")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in X.verdicts(docs, labels).collect()] == [0]
    assert X.verdicts(docs.limit(0), labels).collect() == []


def test_inserted_characters_stay_over_the_threshold(model):
    rnd = random.Random(21)
    clean = [sentence(rnd, 40) for _ in range(200)]
    for marks in ("abcdefghijklmnopqrstuvwxyz0123456789", "*-_."):
        disguised = [f"{c} {w[:k]}{rnd.choice(marks)}{w[k:]}" for c in clean for w in [rnd.choice(BAD)] for k in [rnd.randrange(1, len(w))]]
        assert (model.scores(pa.array(disguised)) >= 0.5).mean() >= 0.95
    assert (model.scores(pa.array(clean)) < 0.5).all()
