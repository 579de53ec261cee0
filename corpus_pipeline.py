"""A corpus pipeline of operators from ``lattis.llm``.

``STAGES`` are (name, function) pairs. Each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of their
``docs``, whatever those are beside ``doc_id``, ``text`` and ``lang``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattis.llm import bin_completion, decontaminate, language_bloom, quality_gbt, simhash_bk
from lattis.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more stay."""
    return quality_gbt.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter, or in another language, go."""
    return language_bloom.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest id."""
    return simhash_bk.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    import public_tokenizers

    return bin_completion.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the first stage; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
