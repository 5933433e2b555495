"""Corpus pipeline over documents: five stages, each written as Parquet and read again.

Toxic documents go; of exact copies one stays; of near copies (five-word shingles, similarity 0.8 or
more) one stays; documents with benchmark passages go; the rest is packed into sequences of 1024
tokens. Every stage but the last returns the columns it was given. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirelake.llm import decontaminate, exact_dedup, packing, similar, toxicity
from wirelake.llm.common import materialize


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the lexicon, learned from the labelled documents, calls toxic."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit(toxicity.labelled(source, labels, toxicity.held_out("doc_id")))
    return toxicity.clean_rows(docs, lexicon)


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.kept_rows(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", exact_copies_out),
    ("simhash_near_dedup", near_copies_out),
    ("decontamination", leaks_out),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
