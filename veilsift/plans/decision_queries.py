"""Whole decisions over documents, conversations and pages, and the streaming operators replayed over a table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, texts
from ..sources import tables
from ..streaming import scans
from . import text_queries

Query = Callable[[SparkSession, str], DataFrame]


def decision_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decisions.decide(docs, language_col="lang").drop("details")


def decision_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for documents with planted phrases and file names."""
    docs = text_queries.tailed(spark, sf_dir)
    names = F.element_at(F.array(*[F.lit(n) for n in text_queries.NAMES]), (F.col("doc_id") % len(text_queries.NAMES)).cast("int") + 1)
    return decisions.decide(docs.withColumn("filename", names), filename_col="filename", language_col="lang").drop("details")


def decision_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every turn of a conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("doc_id"), "text")
    return decisions.decide(turns).drop("details")


def decision_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every page's paragraphs, with the locale hint of its address."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    body = F.array_join(texts.tag_texts(F.col("html"), "p"), "\n")
    return decisions.decide(pages.select(F.col("page_id").alias("doc_id"), "url", texts.decode_entities(body).alias("text")), url_col="url").drop("details")


def stream_root(spark: SparkSession) -> str:
    """The folder that all executors share for what streams read, write and keep."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp()}"
    return root.rstrip("/")


def _replayed(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a streaming transformation over the conversations as events and read back what it wrote.

    Each turn ends with one of the planted phrases, so there is something to find.
    """
    tails = F.array(*[F.lit(t) for t in text_queries.TAILS])
    planted = F.element_at(tails, ((F.col("conv_id") + F.col("turn")) % len(text_queries.TAILS)).cast("int") + 1)
    events = tables.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("role").alias("source"), F.concat_ws(" ", "text", planted).alias("text"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 10 + F.col("turn")).alias("ts")
    )
    folder = f"{stream_root(spark)}/veilsift-stream/{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(scans.EVENTS).parquet(f"{folder}/in")
    query = transform(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, lambda s: scans.first_findings(scans.scan_stream(s)), "append").select("request_id", "pattern_id", "severity", "matched")


def queries() -> dict[str, Query]:
    return {"decision_documents": decision_documents, "decision_planted": decision_planted, "decision_conversations": decision_conversations, "decision_pages": decision_pages, "stream_scan": stream_scan}


def oracle_sql() -> dict[str, str]:
    return {}
