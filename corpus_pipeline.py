"""From documents to packed training sequences, stage by stage.

Each stage reads the Parquet its predecessor wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.llm import ngram_join, packing, pii, poisson_mix, quality
from surety.llm.common import discard, forget, materialise, secret, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    return quality.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of 5-word shingles are linked at a Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, words=5, percent=80).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with format-preserving pseudonyms; n_chars is counted anew."""
    out = pii.pseudonymise(docs.select(*COLUMNS), secret(spark), counts=False)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights that follow the square root of their size, by Poisson replication."""
    return poisson_mix.poisson_mix(docs).select(*COLUMNS)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mix", source_mix), ("packing", best_fit)]
#: No stage but the mixing is expressible in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last, root = table(spark, sf_dir, "documents"), None, f"pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        mark = written()
        docs = materialise(stage(spark, docs, sf_dir), f"{root}-{name}")
        # the stage's own tables and what it read have had their last reader
        forget(spark, mark, docs)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
