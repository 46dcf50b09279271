"""A corpus pipeline: filter by quality, drop recurring lines, drop near-duplicates, mix, pack.

Every stage keeps the columns of its input (other columns, whatever their names, go along), gives no
rows for an empty table and stands null ids, null, empty and very long texts and repeated rows as its
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilsift.llm import common, line_templates, minhash, mixing, packing, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go.

    Null and empty texts weigh 1 and compete like others; rows tied with the last one that stays all stay.
    """
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; documents made of such lines alone go too.

    Null and blank texts stay as they are, and so do rows with a null doc_id.
    """
    return line_templates.without_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Texts without words and rows with a null doc_id stay; rows that repeat a kept doc_id stay.
    """
    return minhash.near_dedup(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their target token weights.

    Null sources and languages are values of their own; repeated rows stay or go together.
    """
    return mixing.mixed(docs, share=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 4096 tokens; an empty text is its end token alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: Trained models and tokenizers are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
