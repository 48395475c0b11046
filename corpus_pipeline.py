"""A corpus pipeline: language ID, quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. A stage sees only what its predecessor kept, and all but the last return the columns of
documents. Null, empty and repeated rows are handled as the operators' docstrings say; empty docs stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import Stash, small_batches
from auditlake.llm.langid import keep_known
from auditlake.llm.minhash import keep_first
from auditlake.llm.packing import pack
from auditlake.llm.rules import keep_good
from auditlake.llm.secrets import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    small_batches(spark)
    return keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak supervision of the quality rules keeps."""
    small_batches(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return keep_first(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark and n_chars counted anew where that happened."""
    small_batches(spark)
    return redact(docs, length="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    small_batches(spark)
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: No SQL: language ID, posteriors and token ids are beyond it. Tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder."""
    docs, stash = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stash(spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash.put(stage(spark, docs, sf_dir))
        stash.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
