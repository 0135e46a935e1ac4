"""A training corpus in five stages over the documents table; each stage works on all that the one before kept.

Stages take rows as they come: null and empty texts, null ids and sources, repeated rows, very long texts, empty tables and further
columns (kept as they are) are all allowed, and each function below says what happens to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, mixing, near_copies, secrets, toxicity
from quern.llm._common import cut, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; null and empty texts stay, repeated rows share their fate."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of texts that share 0.8 of their five-word shingles;
    texts without words, null ones too, are copies of one another, and rows without a doc_id stay."""
    return near_copies.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts and rows without a doc_id are judged by their text alone."""
    return decontaminate.keep_uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets replaced by their kind; null texts stay null, repeated rows are treated alike."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with copy_no; those without words take part with nothing, a null source is one of its own."""
    return mixing.mixed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("secret_scan", redact_secrets), ("source_mix", mix_sources)]

#: Boosted trees, SimHash and hashed rounding can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
