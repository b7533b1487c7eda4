"""The corpus pipeline: documents in, a mixed, deduplicated, decontaminated token store out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; the last returns where each document's ids lie in the store.

1. toxicity: documents scored 0.5 or more go.
2. near_duplicates: of each group of near-duplicates the document of the smallest doc_id stays.
3. decontamination: spans of benchmark items are cut out of texts; a document more than half of which is such spans goes.
4. mixing: documents are dropped or repeated so that sources meet their target weights.
5. tokens: the token store, its documents listed.

A null text is kept by the first three stages: nothing speaks against it. Rows that share a doc_id are kept or dropped together
but for rows that are alike in doc_id and text, of which near_duplicates keeps one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, minhash, mixing, tokenstore, toxicity
from quillspark.llm.common import few, shared_folder, table

#: Fewer than a token store by itself has: here workers come to it from other stages, and executors are full.
REMEMBERED = 200_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("__predicted") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    rest = few(docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti"))
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice"))
    if twice.isEmpty():
        return rest
    alike = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*(c for c in docs.columns if c not in ("doc_id", "text")))
    again = rest.join(twice, F.col("doc_id") == F.col("__twice"), "left_semi").withColumn("__n", F.row_number().over(alike)).where("__n = 1").drop("__n")
    return rest.join(twice, F.col("doc_id") == F.col("__twice"), "left_anti").unionByName(again)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    read = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), column="__match")
    stays = read.where((F.col("__match.n_hit") == 0) | F.col("__match.cleaned").isNotNull())
    text = F.when(F.col("__match.n_hit") > 0, F.col("__match.cleaned")).otherwise(F.col("text"))
    length = F.when(F.col("__match.n_hit") > 0, F.length("__match.cleaned").cast("bigint")).otherwise(F.col("n_chars"))
    return stays.withColumns({"text": text, "n_chars": length} if "n_chars" in docs.columns else {"text": text}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenstore.store_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; between stages a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/quillspark/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs


#: A trained classifier and a token store are beyond SQL; tests/llm/test_pipeline.py checks run() stage by stage.
ORACLE_SQL = None
