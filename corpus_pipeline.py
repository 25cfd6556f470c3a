"""The corpus pipeline: five stages, each over all that the one before it kept.

language ID -> n-gram Jaccard join -> benchmark decontamination -> secret scans -> mixing sources to target weights.  Every
stage but the last returns the columns of documents; so does the last, for the rows it draws.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import decontamination, jaccard_join, language_id, mixing, secrets
from kindred.llm.common import materialise, table

#: Near duplicates in the pipeline: five-word shingles, Jaccard of at least 0.8.
COPY_WIDTH, COPY_NUM = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identifiable language (null texts, texts without a letter); fill null labels."""
    names, model = language_id.learn(docs)
    return language_id.keep_identified(docs, names, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each class of near copies."""
    return jaccard_join.drop_copies(docs, COPY_WIDTH, COPY_NUM)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items, re-parameterised or not."""
    return decontamination.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the text; all documents stay."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents by probabilities raked to the source, language and topic marginals; half of all tokens are expected to stay,
    however rare the rarest source is."""
    return mixing.sample(docs, saturate=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: Learned stages have no SQL.  Tests hold the near-copy stage against brute force and the others against their operators, which
#: have tests of their own; run() as a whole has no brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
