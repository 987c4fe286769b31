"""From raw documents to packed training sequences, in stages that each read what the one before wrote.

quality classifier -> near duplicates -> benchmark decontamination -> PII -> packing
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserine.llm import decontamination, kit, ngram_join, packing, pii, quality
from tesserine.llm.queries import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null texts go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id."""
    return ngram_join.drop_similar(docs, n=3, threshold=0.5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"), n=3, threshold=0.4)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every document or piece of one."""
    return packing.pack(docs, capacity=2048, group_docs=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("pii", without_pii),
    ("packing", packed),
]

#: The classifier, the alignment and the tournament tree can't be written in SQL; tests/llm/test_methods.py has a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result written to the shared folder, read again, and removed when the next is written; null and empty texts, ties, repeated rows and empty tables as each operator's docstring says."""
    docs = table(spark, sf_dir, "documents")
    place = f"{kit.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            kit.remove(spark, f"{place}/{k - 1}")
    return docs
