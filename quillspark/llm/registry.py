"""Queries of the corpus operators, by name, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers

from . import decontaminate, embeddings, langid, licenses, linededup, minhash, mixing, oracles, quality, tokenstore, toxicity
from .common import table


def op1_token_store(spark, sf_dir):
    return tokenstore.store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_vectors(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark, sf_dir):
    return mixing.verdicts(table(spark, sf_dir, "documents"))


def op6_language(spark, sf_dir):
    return langid.verdicts(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return linededup.verdicts(table(spark, sf_dir, "documents"), linededup.PASSAGE_WORDS)


def op10_decontaminate(spark, sf_dir):
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_quality, op3_near_vectors, op4_near_duplicates, op5_mix_sources, op6_language, op7_toxicity, op8_licenses, op9_line_dedup, op10_decontaminate)}
#: Of the others, classifiers and the token store are beyond SQL, and so are seeded draws and content-defined chunks; their tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op3_near_vectors": oracles.NEAR_VECTORS,
    "op4_near_duplicates": oracles.NEAR_DUPLICATES,
    "op8_licenses": oracles.LICENSES,
    "op10_decontaminate": oracles.DECONTAMINATE,
}
