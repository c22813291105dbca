"""The corpus pipeline: quality rules, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.  Between stages the
documents are a written table, so a lost executor costs tasks of one stage.
ORACLE_SQL is None: trees, language models and tokenizers are not SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcweave.llm import langid, neardup, packing, pii, quality
from arcweave.llm.common import read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trees learn from the table labels."""
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt."""
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity of 0.8 or more)."""
    return neardup.keep(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
