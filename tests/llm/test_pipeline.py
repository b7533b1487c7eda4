import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from quillspark.llm import decontaminate, minhash, mixing, toxicity

FIVE = ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's input and output, written and read as the driver does."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(f"file://{folder}/{name}")
        done = spark.read.parquet(f"file://{folder}/{name}")
        out.append((docs, done))
        docs = done
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_names_and_columns(stages, spark, sf):
    assert [n for n, _ in P.STAGES] == FIVE
    for before, after in stages[:4]:
        assert after.columns == spark.read.parquet(f"{sf}/documents.parquet").columns == before.columns


def test_toxicity_drops_what_it_rejects(stages, spark, sf):
    docs, kept = stages[0]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("__predicted = 1").collect()}
    assert rows(kept) == Counter({r: n for r, n in rows(docs).items() if r[0] not in bad}) and bad


def test_one_document_of_each_group_stays(stages):
    docs, kept = stages[1]
    stay = {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == stay and kept.count() == len(stay) < docs.count()


def test_no_benchmark_words_are_left(stages, spark, sf):
    docs, clean = stages[2]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    before, after = ({r.doc_id: r for r in decontaminate.verdicts(d, bench).collect()} for d in (docs, clean))
    assert any(r.contaminated for r in before.values()) and not any(r.contaminated for r in after.values())
    old, new = ({r.doc_id: r.text for r in d.collect()} for d in (docs, clean))
    for d, r in before.items():
        if not r.contaminated:
            assert new[d] == old[d]
        elif r.n_hit <= r.n_words / 2:
            assert len(new[d]) < len(old[d])
        else:
            assert d not in new


def test_mixing_takes_what_the_operator_says(stages):
    docs, mixed = stages[3]
    want = Counter({r.doc_id: r.copies for r in mixing.mix(docs, ["doc_id", "source"]).collect() if r.copies})
    assert Counter(r.doc_id for r in mixed.collect()) == want


def test_tokens_are_those_of_the_mixed_texts(stages, spark, sf):
    mixed, listed = stages[4]
    tok, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(mixed.collect(), key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(map(tuple, listed.collect()), key=lambda r: r[1]) == want
    assert rows(P.run(spark, sf)) == rows(listed)


ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "text without an id", None, "a", 18), (3, "same words in both of these", "en", "a", 27), (3, "same words in both of these", "en", "a", 27), (4, "same words in both of these", "fr", "b", 27), (5, "long " * 40_000, "en", "a", 200_000)]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_every_stage(spark, sf, empty):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([] if empty else ODD, schema)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns
            docs = spark.createDataFrame([tuple(r) for r in got], schema)
        if name == "near_duplicates" and not empty:
            assert Counter(r.doc_id for r in got) == Counter([1, 2, None, 3, 5])
    assert (len(got) == 0) == empty
