"""The corpus pipeline: language ID, quality classifier, near-duplicate removal, packing.

STAGES are (name, function of (spark, docs, sf_dir)); run() applies them to the
documents, each stage written as Parquet in the shared folder and read again, and deleted
when the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import jaccard, language, packing, quality
from textloom.llm.common import drop_stored, relieve_executors, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language of half their words, go."""
    return language.keep_known(docs, language.fit(docs), least=0.5)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text finds too strange go."""
    relieve_executors(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8 stays."""
    relieve_executors(spark)
    return jaccard.keep_one(docs, percent=80, width=5)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of 4096 tokens."""
    relieve_executors(spark)
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Learnt models and packing are not SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if k:
            drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
