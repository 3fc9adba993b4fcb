"""From raw documents to packed sequences in five stages; each stage's result is a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlight.llm.line_dedup import EXACT_CHARS, dedup_lines
from wardlight.llm.mixing import mixed_documents
from wardlight.llm.ngram_join import one_of_each
from wardlight.llm.packing import packed_documents
from wardlight.llm.quality_rules import quality_filter
from wardlight.llm.queries import tokenizer_path
from wardlight.llm.shared import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and rejected documents."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go, and documents that lose all their words."""
    return dedup_lines(docs, shortest=EXACT_CHARS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram join", ngram_join), ("mixing", mixing), ("packing", packing)]

#: Packing and the similarity stages can't be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
