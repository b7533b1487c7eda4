import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import common
from quillspark.llm import tokenstore as S

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def brute(rows):
    out, start = [], 0
    whole = [(d, [*TOK.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]
    for d, ids in sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return r[1]


@given(st.lists(st.integers(0, 1 << 45), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values.sort()
    code = S.EliasFano.from_bytes(S.EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert code.decode().tolist() == values
    assert [code.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_space_is_near_the_minimum():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(S.EliasFano.encode(values).to_bytes()) * 8 / len(values) < 2.3 + np.log2(values[-1] / len(values))


@given(st.text(st.sampled_from(" \n\t ab'sé,.1<|endoftext|>　\x1c"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_pieces_give_the_ids_of_the_whole_text(text):
    coder = S.encoder(PATH)
    ids, bounds = coder.encode(["", text, f"a {text} b"])
    whole = [[*TOK.encode(t, add_special_tokens=False).ids, 2] for t in ("", text, f"a {text} b")]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == whole


def test_encoder_forgets_and_goes_on():
    coder = S.PieceEncoder(PATH, keep=50)
    for k in range(30):
        texts = [f"some words {k} and wörds{k * j} more\n" for j in range(9)]
        ids, bounds = coder.encode(texts)
        assert [ids[a : b - 1].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [TOK.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((tuple(r) for r in S.store_and_read(docs, PATH).collect()), key=key)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_pieces_remembered_do_not_change_the_store(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((tuple(r) for r in S.store_and_read(docs, PATH, keep=200).collect()), key=key)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_large_object_a_process():
    first = common.kept("a", lambda: [1])
    assert common.kept("a", lambda: [2]) is first
    assert common.kept("b", lambda: [3]) == [3] and common.kept("a", lambda: [4]) == [4]


def test_blocks_are_written_without_the_encoder(spark, sf, tmp_path, monkeypatch):
    pack = S.pack_block

    def checked(*block):
        from quillspark.llm.common import _slot

        assert not _slot, "the worker still holds its encoder"
        return pack(*block)

    monkeypatch.setattr(S, "pack_block", checked)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        S.write_store(spark.read.parquet(f"{sf}/documents.parquet").repartition(16), f"file://{tmp_path}/store", PATH, shards=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


ROWS = [(5, "five"), (-3, "minus"), (None, "no id"), (5, "five"), (5, "another"), (0, None), (1, ""), (2**60, "word " * 30000), (None, None)]


def test_cases_blocks_and_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id bigint, text string, ids int")
    for shards, block in ((1, 10), (3, 1 << 20), (50, 1)):
        path = f"file://{tmp_path}/{uuid.uuid4().hex}"
        S.write_store(docs, path, PATH, shards=shards, block_ids=block)
        assert sorted((tuple(r) for r in S.placed_documents(spark, path).collect()), key=key) == brute(ROWS)
        back = sorted(((r.doc_id, TOK.decode(r.ids[:-1], skip_special_tokens=False)) for r in S.read_store(spark, path).collect()), key=str)
        assert back == sorted(((d, t or "") for d, t in ROWS), key=str)


def test_block_selects_documents():
    docs = [np.arange(n, dtype="<u2").tobytes() for n in (1, 0, 700, 3)]
    block = S.Block(S.pack_block([1, 1, 4, None], docs, 2, 10))
    assert [block.document(i).tobytes() for i in range(4)] == docs and block.doc_ids() == [1, 1, 4, None]
    with pytest.raises(ValueError):
        S.Block(b"nothing of the kind")


def test_empty_table(spark):
    assert S.store_and_read(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
