"""A corpus pipeline of five text operators over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; its result is written as Parquet in the shared folder and read again, so a
lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelworks.llm import bpe, langid, secrets, simhash, templates
from panelworks.llm.common import table
from panelworks.session import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence.

    A null text, an empty one and one without a letter go; repeated rows are judged
    alike; a null doc_id is no reason to go. Without any labelled row all rows stay.
    """
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near-equal documents.

    A row without doc_id stays. Texts without words are one group. Rows that repeat
    the smallest doc_id stay as often as they stand there.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a benchmark item.

    A row without doc_id, a null text and an empty one stay; null items and an empty
    benchmark match nothing; rows of one doc_id go together.
    """
    return templates.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of their secrets, and n_chars counted again; null texts stay null."""
    return secrets.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's ids and decoded text; a null text counts as empty."""
    return bpe.digests(bpe.round_trip(docs))


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("tokens", tokens),
]

#: models, fingerprints and the tokenizer have no SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
