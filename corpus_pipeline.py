"""The corpus pipeline: stages that each take the documents the stage before has kept.

run(spark, sf_dir) writes every stage's result as Parquet under the shared folder
and rereads it. Stages keep the columns of documents, whatever they are called;
the last gives tokens instead.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from acreledger.llm import decontam, langid, pieces, simhash, toxicity
from acreledger.llm.common import prepare, table
from acreledger.sources.storage import shared_dir

ORACLE_SQL = None


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold. Learned from the labels of documents outside the held-out fold."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out_fold())
    return toxicity.accept(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; texts without letters go."""
    prepare(spark)
    return langid.accept(docs, langid.fit(docs, ~langid.held_out_fold()))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of SimHash near duplicates (3-word shingles, 3 bits)."""
    prepare(spark)
    return simhash.keep_one(docs, shingle_words=3, max_bits=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark doesn't contaminate."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids and n_tokens of every row, and whether decoding gives the text back."""
    from pyspark.sql import functions as F

    prepare(spark)
    coded = pieces.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [("toxicity", not_toxic), ("language_id", known_language), ("simhash_near_dedup", one_of_each), ("decontamination", without_benchmark), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
