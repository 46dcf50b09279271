"""Exact deduplication over an extendible-hash index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


def normalised(text_col: str) -> Column:
    return F.regexp_replace(common.text_or_empty(text_col), common.SPACE_RUN, " ")


def directory(counts: DataFrame, capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """Split buckets by doubling until none is overfull: (first slot, depth, size) of each bucket.

    ``counts`` has (slot, n), what lies in slots of ``max_depth`` leading hash bits, at most
    2**max_depth rows. A bucket of depth d owns the slots that share its d leading bits. Doubling ends
    at ``max_depth``; a bucket there may be fuller, and its owner's sort spills to disk.
    """
    full = dict(counts.collect())
    level = {0: sum(full.values())}
    done: list[tuple[int, int, int]] = []
    for depth in range(max_depth + 1):
        over = {b for b, n in level.items() if n > capacity and depth < max_depth}
        done += [(b << (max_depth - depth), depth, n) for b, n in level.items() if b not in over]
        level = {}
        for b in over:
            level[2 * b] = level[2 * b + 1] = 0
        shift = max_depth - depth - 1
        for slot, n in full.items() if over else ():
            if (slot >> shift) in level:
                level[slot >> shift] += n
    return sorted(done)


def pointers(buckets: list[tuple[int, int, int]], max_depth: int) -> tuple[int, list[int]]:
    """The directory's global depth and, for each of its slots, the number of the bucket it points to."""
    depth = max((d for _, d, _ in buckets), default=0)
    return depth, [i for i, (_, d, _) in enumerate(buckets) for _ in range(1 << (depth - d))] or [0]


def _bits(depth: int) -> Column:
    """The leading bits of the hash."""
    return F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 4 << 20, max_depth: int = 18, hash_bits: int = 64) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when they agree byte for byte after each run of ASCII white space became one
    space. The smallest doc_id of equal texts stays. Null texts count as empty; null doc_ids sort
    after all others, so they stay only where no other row has the text; rows that repeat the kept
    doc_id with the same text are all marked kept; an empty table gives no rows; other columns are
    ignored. ``bucket`` and ``chain`` tell where the index holds a text.

    1. A pass over hashes counts bytes by leading hash bits (at most 2**max_depth numbers reach the
       driver). Directory doubling splits each bucket with more than ``bucket_bytes`` of rows.
    2. The directory (one number a slot) is broadcast and sends every row to its bucket; the task that
       owns a bucket sorts its range of hashes and compares bytes: equal texts form a group, different
       texts of one hash a chain in byte order. Owners write their postings to shared files.
    3. A hash with more rows or bytes than an even share of a task (at most twice as many as tasks) is
       hot: its rows stay where they are, each map task sends one entry a text, and rows look their
       entry up by broadcast.

    ``hash_bits`` below 64 shortens the hash, which makes chains longer and changes no group.
    """
    tasks = common.partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t").bitwiseAND(F.lit(-1 << (64 - hash_bits))))
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t") + F.lit(8)).alias("bytes"))
    sizes = common.stored(sizes, "hash-sizes")
    n, size = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    is_hot = (F.col("n") > max(1, n // tasks)) | ((F.col("n") > 1) & (F.col("bytes") > size // tasks))

    cold = sizes.where(~is_hot).groupBy(_bits(max_depth).alias("slot")).agg(F.sum("bytes").alias("n"))
    depth, pointed = pointers(directory(cold, bucket_bytes, max_depth), max_depth)
    written = F.split(F.lit(",".join(map(str, pointed))), ",").cast("array<int>")  # at most 2**max_depth numbers
    table = docs.sparkSession.range(1).select(F.posexplode(written).alias("slot", "bucket"))
    hot = sizes.where(is_hot).select("h", F.lit(True).alias("hot"))  # at most two for each task
    routed = rows.withColumn("slot", _bits(depth)).join(F.broadcast(table), "slot").drop("slot").join(F.broadcast(hot), "h", "left")

    link = F.dense_rank().over(Window.partitionBy("bucket", "h").orderBy("t")) - 1
    same = Window.partitionBy("bucket", "h", "t")
    owned = routed.where("hot is null").repartition("bucket")
    owned = owned.select("doc_id", F.min("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"), F.sha2("t", 256).alias("sha"), "bucket", "h", link.alias("chain"))

    entries = routed.where("hot").groupBy("bucket", "h", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = entries.select("h", F.sha2("t", 256).alias("sha"), "keep_id", "group_size", "bucket", link.alias("chain"))
    entries = common.stored(entries, "hot-entries")
    named = routed.where("hot").select("doc_id", "h", F.sha2("t", 256).alias("sha")).join(F.broadcast(entries), ["h", "sha"])
    index = common.stored(owned.unionByName(named), "hash-index")
    return index.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that repeat a kept doc_id with the same text stay too; nulls and missing rows are as in
    ``exact_duplicates``.
    """
    kept_id, kept_sha = common.own_names(docs, "__kept_id", "__kept_sha")
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    same = docs[id_col].cast("long").eqNullSafe(kept[kept_id]) & (F.sha2(normalised(text_col), 256) == kept[kept_sha])
    return docs.join(kept, same, "left_semi")


#: The same result in DuckDB's SQL.
EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
