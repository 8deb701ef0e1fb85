"""A training corpus from raw documents: quality, near copies, leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
The first four return the columns of ``documents``; the last returns token counts and
digests. Rows without doc_id cannot be joined to a decision and are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from convolytics.llm import jaccard, leaks, pieces, quality, secrets
from convolytics.llm.common import keep, small_batches
from convolytics.llm.queries import table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id, with shingles of
    five words and a similarity of 0.8."""
    small_batches(spark)
    return jaccard.representatives(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets in its text replaced by a mark."""
    small_batches(spark)
    return secrets.without_secrets(docs)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    small_batches(spark)
    return pieces.token_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


#: (name, function of (spark, docs, sf_dir)), in the order in which they are applied.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", token_digests),
]
#: SQL can express neither the classifier nor the encoder: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{number}")
    return docs
