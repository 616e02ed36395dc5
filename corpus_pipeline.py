"""The corpus pipeline: five stages, each an operator over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, line_dedup, minhash, mixing, quality
from corpusloom.session import prepare, saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose perplexity is within their language's band."""
    return quality.quality(prepare(spark), docs, keep=tuple(docs.columns)).filter("kept").select(*docs.columns)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks that an earlier document has; documents with nothing left go."""
    return line_dedup.drop_repeated_lines(prepare(spark), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.drop_near_duplicates(prepare(spark), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(prepare(spark), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of each document of the mix."""
    prepare(spark)
    return bpe.bpe_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_chunks),
    ("minhash near-dedup", near_duplicates),
    ("source mix", source_mix),
    ("byte-level bpe", byte_bpe),
]

#: SQL cannot express the language model, the shingle sets' components or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, spark)
    return docs
