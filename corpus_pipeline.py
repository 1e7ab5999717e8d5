"""From documents to packed training sequences: five stages, each of one operator.

``language`` drops texts without a main language, ``near_duplicates`` keeps one document of each group of near copies (five-word
shingles, similarity 0.8), ``decontamination`` drops documents that hold a benchmark item, ``secrets`` replaces
live-looking credentials in the text, ``packing`` turns what is left into token pieces placed in sequences.

All stages but the last return the columns of documents. Null and empty texts have no language and go in the first
stage. Clashing column names (the operators' own) are not touched, since stages carry rows as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.llm import decontamination, jaccard, language, packing, secrets
from relayout.llm.shared import release, scratch, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.with_main_language(docs, F.lit(True))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, 5, 80, 100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


def _tidy(number: int, stage: Stage) -> Stage:
    """The stage with scratch tables of its own; those of the one before go, since its result is stored by now."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, f"pipeline {sf_dir} {number - 1}")
        with scratch(f"pipeline {sf_dir} {number}"):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (name, _tidy(number, stage))
    for number, (name, stage) in enumerate(
        [
            ("language", identified),
            ("near_duplicates", deduplicated),
            ("decontamination", decontaminated),
            ("secrets", redacted),
            ("packing", packed),
        ]
    )
]

#: Learned models and tokenizers have no SQL; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; its scratch tables go when the next one begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
