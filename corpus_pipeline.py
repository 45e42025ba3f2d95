"""A training corpus from documents: toxic documents go, repeated lines go, one of each group of near duplicates stays, sources are
mixed to their weights, and what is left is encoded.

Each stage takes the rows that the one before kept, in the columns of documents, and leaves clean rows as they are.  The last
returns doc_id, lang, source, n_tokens, tokens and round_trip.  Mixing isn't a filter: by its weights rows of the largest language may go,
and rows of the smaller ones may come twice or more.

Defined cases: rows with null text pass the first three stages and go in mixing, as empty texts do, since they hold no tokens to mix; rows without an id pass
all of them, and those that repeat an id become one in near_dedup; ties go to the smallest id; an empty table gives an empty result; other
columns, of any name, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bpe, line_dedup, mixing, near_dup, toxicity
from recordloom.llm.common import made, remove, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.stage(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(docs, mixing.plan(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

# Ordinal regression, MinHash, min-cost flow and byte pair merges are beyond SQL; run() is held against a plain version in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = made()
        docs = written(stage(spark, docs, sf_dir), name)
        remove(spark, since, keep=1)  # what the stage wrote on its way; nothing reads it once its result is there
    return docs
