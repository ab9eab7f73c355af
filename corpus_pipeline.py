"""A corpus pipeline: quality, near duplicates, secrets, mixing, tokens. Each stage reads what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrapane.llm import bpe, classifier, jaccard, mixing, secrets
from terrapane.llm.common import materialize, recorded, release, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return classifier.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of each secret."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each document, with the texts that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_and_decode(docs, path)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("encode_tokens", encode_tokens),
]
#: The stages are beyond SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with recorded() as steps:
            docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, steps[:-1])  # the stage's own steps; its result stays
    return STAGES[-1][1](spark, docs, sf_dir)
