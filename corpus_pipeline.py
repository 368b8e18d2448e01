"""A training corpus in four stages: toxic documents go, one document of each group of near copies
stays, sources are mixed to target weights, and the rest is encoded. A stage takes
``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; its rows are written as
Parquet below the shared folder and read again as the next one's ``docs``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import jaccard, mixing, pieces, toxicity
from seriesloom.llm.common import documents
from seriesloom.session import scratch_path, shuffles_dropped
from seriesloom.sources.tables import table

COPY_WORDS, COPY_PERCENT = 5, 80
#: chunks in a task's table: workers that ran the stages before hold memory of their own
KEPT_CHUNKS = 100_000


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on those of the stage's input with labels, does not reject."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by sets of five-word shingles with a
    Jaccard similarity of 0.8 or more."""
    return jaccard.without_copies(docs, COPY_WORDS, COPY_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mixture: number of ids, and digests of the ids and of the decoded text."""
    return pieces.encode_digests(docs, public_tokenizers.path(pieces.MODEL), KEPT_CHUNKS)


STAGES = [("toxicity", without_toxic), ("near copies", without_copies), ("mixing", mixed), ("encoding", encoded)]
#: no SQL trains the network or knows the pieces
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name.replace(' ', '-')}")
        kept = stage(spark, docs, sf_dir)
        with shuffles_dropped(spark):
            kept.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
