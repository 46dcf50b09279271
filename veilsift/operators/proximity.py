"""Nearness of findings within a document: nearest anchor, clusters, lists. One sort by place each, no pairwise join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest(left: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """For each left row its nearest anchor within ``reach``: anchor_seq, distance. Needs doc_id, seq, offset.

    Of anchors at one distance the one with the smaller place wins, then the smaller seq. Both tables are
    laid out by document and place once; the last anchor at or before a row and the first at or after it
    come from running windows, so a document with many of both makes no pairs.
    """
    rows = left.select("doc_id", "offset", F.col("seq").alias("seq"), F.lit(None).cast("long").alias("a"))
    marks = anchors.select("doc_id", "offset", F.lit(None).cast("long").alias("seq"), F.col("seq").cast("long").alias("a"))
    both = rows.unionByName(marks)
    entry = F.when(F.col("a").isNotNull(), F.struct("offset", "a"))
    by_place = Window.partitionBy("doc_id").orderBy("offset")
    # of anchors at one place the smallest seq stands for all
    lowest = F.min("a").over(Window.partitionBy("doc_id", "offset"))
    both = both.withColumn("a", F.when(F.col("a") == lowest, F.col("a")))
    before = F.max(entry).over(by_place.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(entry).over(by_place.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumn("b", before).withColumn("f", after).where("seq is not null")
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("offset") - F.col(f"{c}.offset")).alias("distance"), F.col(f"{c}.offset").alias("at"), F.col(f"{c}.a").alias("a"))) for c in ("b", "f")])))
    found = found.withColumn("best", best).where(F.col("best.distance") <= reach)
    return found.select("doc_id", "seq", F.col("best.a").alias("anchor_seq"), F.col("best.distance").alias("distance"))


def dense_clusters(rows: DataFrame, n: int, span: int) -> DataFrame:
    """Whether ``n`` rows of a document lie within ``span`` characters, and the tightest such span."""
    gap = F.lead("offset", n - 1).over(Window.partitionBy("doc_id").orderBy("offset", "seq")) - F.col("offset")
    return rows.withColumn("gap", gap).groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("gap") <= span), F.lit(False)).alias("clustered"), F.min("gap").alias("tightest"))


def different_kinds_near(rows: DataFrame, span: int) -> DataFrame:
    """Whether two rows of different ids lie within ``span``: if any do, some neighbours in place order do."""
    w = Window.partitionBy("doc_id").orderBy("offset", "seq")
    close = (F.col("id") != F.lag("id").over(w)) & (F.col("offset") - F.lag("offset").over(w) <= span)
    return rows.withColumn("close", close).groupBy("doc_id").agg(F.coalesce(F.bool_or("close"), F.lit(False)).alias("near"))


def lists(rows: DataFrame, least: int, span: int) -> DataFrame:
    """Ids of which a document has ``least`` different matches within ``span`` characters (or without places)."""
    out = rows.groupBy("doc_id", "id").agg(F.countDistinct("match").alias("matches"), (F.max("offset") - F.min("offset")).alias("span"), F.count("offset").alias("placed"))
    return out.select("doc_id", "id", "matches", "span", ((F.col("matches") >= least) & ((F.col("placed") == 0) | (F.col("span") <= span))).alias("is_list"))
