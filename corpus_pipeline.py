"""Corpus pipeline over ``documents``: quality rules, SimHash near-dedup, personal data,
source mixing, BPE.

Every stage takes (spark, docs, sf_dir), calls one operator of ``auditlake.llm`` and returns a
DataFrame, which ``run`` writes as Parquet and reads back as the next stage's docs; all but
the last return the columns of ``documents``. Defined results are those of the operators: null
texts fail the quality rules, extra columns pass through the first four stages unchanged, an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import bpe, mixing, pii, quality, simhash
from auditlake.llm.common import table, written
from auditlake.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component."""
    return simhash.keep_one_per_group(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources up to MAX_EPOCHS times."""
    return mixing.mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row per mixed document."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("personal_data", personal_data_stage),
    ("source_mixing", mixing_stage),
    ("bpe", bpe_stage),
]

# SimHash components and BPE have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
