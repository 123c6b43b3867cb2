"""From raw documents to a training mix: five stages, each one operator of tidemark.llm over all that is left.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last returns the repetitions of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, language, mixing, near_duplicates, secrets
from tidemark.llm.common import settle, table
from tidemark.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is not identified go: null, without letters, or undecided."""
    pieces = vocabulary("piece_bpe_32k.model")
    return language.keep_identified(docs, language.fit(docs, pieces), pieces)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: five-word shingles, similarity 0.8."""
    return near_duplicates.drop_near_duplicates(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold at least 0.8 of a benchmark item go, each judged by its own text."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repetitions of the documents that bring their sources to the target weights."""
    return mixing.mixed(docs, mixing.ranked_weights(docs))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
]

#: Language models and sketches have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = settle(docs)
    return docs
