"""The stream of pieces replayed over documents: each text comes in pieces that several micro-batches deal out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import chunks
from . import text_queries
from .decision_queries import stream_root

Query = Callable[[SparkSession, str], DataFrame]

PIECE, BATCHES = 3000, 3


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents whose pieces arrive in three batches, every third piece in each, so most wait for their turn."""
    n = F.size("parts")
    docs = text_queries.tailed(spark, sf_dir).withColumn("parts", F.transform(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(PIECE)), lambda i: F.substring("text", i + 1, F.lit(PIECE))))
    begun = F.timestamp_seconds(F.lit(1_700_000_000))
    pieces = docs.select("doc_id", n.alias("of"), F.posexplode("parts").alias("n", "piece")).select(
        F.concat(F.lit("reader-"), F.col("doc_id").cast("string")).alias("source"), F.col("doc_id").cast("string").alias("request_id"), begun.alias("started"), F.col("n").cast("int").alias("n"), "piece", (F.col("n") == F.col("of") - 1).alias("last"), begun.alias("ts")
    )
    folder = f"{stream_root(spark)}/veilsift-stream/{uuid.uuid4().hex}"
    before = spark.conf.get(chunks.STATE_STORE)
    chunks.keep_state_in_rocksdb(spark)
    try:
        for i in range(BATCHES):
            # a batch is all files that have come, as many as there are tasks; the stream goes on from its state
            pieces.where(F.col("n") % BATCHES == i).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(chunks.PIECES).parquet(f"{folder}/in")
            found = chunks.findings(chunks.chunk_stream(stream))
            found.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(chunks.STATE_STORE, before)
    return spark.read.parquet(f"{folder}/out").select(F.col("request_id").cast("long").alias("doc_id"), "id", "severity", F.col("offset").cast("int").alias("offset"), "matched")


def queries() -> dict[str, Query]:
    return {"stream_chunks": stream_chunks}


def oracle_sql() -> dict[str, str]:
    return {"stream_chunks": text_queries._chunk_scan_sql()}
