"""Ranked lexical search: an index of shards with variable blocks, and exact block-skipping search.

Every task that reads texts makes shards of its own of them, each of bounded size, so texts are never
shuffled. A shard holds a posting list for each of its terms: documents in ascending doc_id order and
their impacts (the part of a score that a term's weight is multiplied with). Lists are cut into blocks
where dynamic programming puts the boundaries: the sum of bound errors (how far a block's largest
impact lies above its impacts) plus a price for each block is the least possible.

A search reads the lists of the items' terms only. In a shard, the weighted block maxima of an item's
terms that cover a document sum up to a bound on its score; documents are scored in the order of their
bounds, in growing rounds, until no bound reaches the k-th best score so far (the pivot test of
block-max WAND, made for all documents of a shard at once). Blocks none of whose documents are scored
are never opened. The result is exact, ties included.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

INDEX = "shard long, term binary, n int, docs binary, impacts binary, ends binary, tops binary"

#: A shard is closed at so many postings; one holds at least one document.
SHARD_POSTINGS = 1 << 20
#: The most postings of a block, and the price of a block in impacts.
WIDEST = 64
BLOCK_PRICE = 1_000_000
#: Pairs of item and term that are searched for at a time; items are dealt to blocks of about so many.
PAIRS = 200_000
#: Stands for a null doc_id in shards, before all others.
NULL_ID = -(2**63)


def _letters() -> bytes:
    """For each byte, what it is in a term: A-Z in lower case, digits, a-z and all beyond ASCII as they are, others a space."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


LETTERS = _letters()


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(LETTERS).split()


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).cast("binary").alias("text"))


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N, the documents with at least one term, and L, all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        for batch in common.slices(batches):
            for text in batch.column(0).to_pylist():
                found = len(terms(text))
                n += found > 0
                size += found
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "size": pa.array([size], pa.int64())})

    parts = docs.select(common.text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(run, "n long, size long")
    row = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return row[0], row[1]


def block_ends(impacts: np.ndarray, starts: np.ndarray, lengths: np.ndarray, widest: int = WIDEST, price: int = BLOCK_PRICE) -> tuple[np.ndarray, np.ndarray]:
    """Best blocks of many lists at once: list and end (within the list) of each block, in order.

    A block of m postings with largest impact t costs m * t + price; the sum of impacts is the same
    for all cuts, so the least sum of costs is the least sum of bound errors. All lists advance
    together, one posting a step, the longest first; blocks have at most ``widest`` postings.
    """
    order = np.argsort(-lengths, kind="stable")
    owner, ends = [], []
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        if longest == 0:
            break
        group = order[at : at + max(1, min(4096, 4_000_000 // longest))]
        at += len(group)
        n, width = lengths[group], min(widest, longest)
        sizes = np.arange(1, width + 1, dtype=np.int64)
        tops = np.zeros((len(group), width), np.int64)
        costs = np.full((len(group), width), 1 << 60, np.int64)
        costs[:, 0] = 0
        chosen = np.zeros((longest, len(group)), np.int16)
        for j in range(longest):
            a = int(np.searchsorted(-n, -j, side="left"))  # lists with more than j postings
            s = impacts[starts[group[:a]] + j]
            tops[:a, 1:] = np.maximum(tops[:a, :-1], s[:, None])
            tops[:a, 0] = s
            sums = tops[:a] * sizes + costs[:a]
            pick = sums.argmin(1)
            chosen[j, :a] = pick + 1
            best = sums[np.arange(a), pick] + price
            costs[:a, 1:] = costs[:a, :-1]
            costs[:a, 0] = best
        rest, lists = n.copy(), np.flatnonzero(n)
        while len(lists):
            owner.append(group[lists])
            ends.append(rest[lists])
            rest[lists] -= chosen[rest[lists] - 1, lists]
            lists = lists[rest[lists] > 0]
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, ends = np.concatenate(owner), np.concatenate(ends)
    by = np.lexsort((ends, owner))
    return owner[by], ends[by]


class Shard:
    """Collects documents; ``rows`` are the shard's index rows in ascending term order."""

    def __init__(self, number: int, n: int, size: int):
        self.number, self.n, self.size = number, n, size
        self.ids, self.lengths = array("q"), array("q")
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.counts, self.each = array("i"), array("i"), array("i")

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = terms(text)
        if not words:
            return
        counts, known = Counter(words), self.vocabulary
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(words))
        self.each.append(len(counts))
        self.terms.extend([known.setdefault(w, len(known)) for w in counts])
        self.counts.extend(counts.values())

    def rows(self) -> pa.RecordBatch:
        ids, lengths = np.array(self.ids), np.array(self.lengths)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        words = sorted(self.vocabulary)
        place = np.empty(len(words), np.int64)
        place[[self.vocabulary[w] for w in words]] = np.arange(len(words))
        term, tf = place[np.array(self.terms)], np.array(self.counts, np.int64)
        doc = np.repeat(rank, np.array(self.each))
        m = 10 + 90 * np.repeat(lengths, np.array(self.each)) * self.n // self.size
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        by = np.argsort(term * len(ids) + doc)
        doc, impact = doc[by].astype("<i4"), impact[by]
        lists = np.bincount(term, minlength=len(words))
        starts = np.cumsum(lists) - lists
        owner, ends = block_ends(impact, starts, lists)
        first = np.concatenate([[0], (starts[owner] + ends)[:-1]])
        tops = np.maximum.reduceat(impact, first).astype("<i4")
        blocks = np.bincount(owner, minlength=len(words))
        # the documents' ids are the list of the empty term, which no text has
        empty = [b""]
        columns = [
            pa.array(np.full(len(words) + 1, self.number), pa.int64()),
            pa.array(empty + words, pa.binary()),
            pa.array(np.concatenate([[len(ids)], lists]), pa.int32()),
            _binary(np.sort(ids).astype("<i8").tobytes(), doc, lists),
            _binary(b"", impact.astype("<i4"), lists),
            _binary(b"", ends.astype("<i4"), blocks),
            _binary(b"", tops, blocks),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n", "docs", "impacts", "ends", "tops"])


def _binary(head: bytes, values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """``head``, then the bytes of ``values`` in runs of ``lengths``."""
    offsets = len(head) + np.concatenate([[-len(head), 0], 4 * np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.binary(), len(lengths) + 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(head + values.tobytes())])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The index of all terms of all texts, written to the shared folder: INDEX, one row a term of a shard.

    Null, empty and termless texts are not in it. Null and repeated doc_ids are documents of their
    own. An empty table gives an empty index.
    """
    n, size = totals(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made = 0
        shard = Shard(part << 24, n, size)
        for batch in common.slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.add(doc_id, text)
                if len(shard.terms) >= shard_postings:
                    yield from common.slices([shard.rows()], 16_384)
                    made += 1
                    shard = Shard((part << 24) + made, n, size)
        if len(shard.ids):
            yield from common.slices([shard.rows()], 16_384)

    return common.stored(_plain(docs, id_col, text_col).mapInArrow(run, INDEX), "lexical-index").withColumn("documents", F.lit(n).cast("long"))


def search_shard(lists: dict[bytes, tuple], ids: np.ndarray, items: dict, weights: dict[bytes, int], k: int) -> Iterator[tuple[int, int, int]]:
    """The k best documents of a shard for each item: item, doc_id, score; equal scores by place.

    ``lists`` has docs, impacts, ends and tops of each term.
    """
    for item, wanted in items.items():
        mine = [(weights[t], *lists[t]) for t in wanted if t in lists]
        if not mine:
            continue
        # each block adds its weighted largest impact from its first document to its last
        steps = np.zeros(len(ids) + 1, np.int64)
        for w, docs, _, ends, tops in mine:
            begins = np.concatenate([[0], ends[:-1]])
            steps[docs[begins]] += w * tops.astype(np.int64)
            steps[docs[ends - 1] + 1] -= w * tops.astype(np.int64)
        bounds = np.cumsum(steps[:-1])
        order = np.argsort(-bounds, kind="stable")[: np.count_nonzero(bounds)]
        best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, size = 0, 4 * k
        while at < len(order) and (len(best) < k or bounds[order[at]] >= best[-1]):
            asked = np.sort(order[at : at + size])
            scores = np.zeros(len(asked), np.int64)
            for w, docs, impacts, _, _ in mine:
                spot = np.searchsorted(docs, asked)
                spot[spot == len(docs)] = 0
                scores += np.where(docs[spot] == asked, w * impacts[spot].astype(np.int64), 0)
            best_docs, best = np.concatenate([best_docs, asked]), np.concatenate([best, scores])
            keep = np.lexsort((best_docs, -best))[:k]
            best_docs, best = best_docs[keep], best[keep]
            at, size = at + size, 2 * size
        for d, s in zip(best_docs.tolist(), best.tolist(), strict=True):
            if s > 0:
                yield item, int(ids[d]), s


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct terms of each item: item, term. Rows of one item_id are one item; null ids are one, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 64):
            found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])

    plain = items.select(F.col(item_col).cast("long").alias("item"), common.text_or_empty(text_col).cast("binary").alias("text"))
    return plain.mapInArrow(run, "item long, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct()


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """The k best documents of the whole index for each item: item_id, rank, doc_id, score.

    Scores above 0 only; equal scores by ascending doc_id (null first), repeated doc_ids are
    documents of their own. Items without terms, or none of whose terms is in the index, give no
    rows. Items go in blocks of about ``pairs`` terms, whose terms and weights are broadcast; an item
    is never split. Only lists of the block's terms are read and shuffled, to one task a shard.
    """
    spark = index.sparkSession
    asked = common.stored(item_terms(items, item_col, text_col), "item-terms")
    blocks = -(-asked.count() // pairs)
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else asked
        found = _search(index, block, k)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def _search(index: DataFrame, block: DataFrame, k: int) -> DataFrame:
    spark = index.sparkSession
    wanted: dict[int | None, list[bytes]] = {}
    for r in block.collect():  # at most about PAIRS rows
        wanted.setdefault(r.item, []).append(bytes(r.term))
    vocabulary = spark.createDataFrame(pa.table({"term": pa.array(sorted({t for ts in wanted.values() for t in ts}), pa.binary())}))
    known = index.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df"), F.first("documents").alias("N"))
    weights = {bytes(r.term): math.floor(1000 * math.log((2 * r.N + 2) / (2 * r.df + 1))) for r in known.collect()}
    sent = spark.sparkContext.broadcast((wanted, weights))
    every = vocabulary.union(spark.createDataFrame([(bytearray(),)], vocabulary.schema))

    def run(table: pa.Table) -> pa.Table:
        items, by_term = sent.value
        lists, ids = {}, np.zeros(0, np.int64)
        rows = [table.column(c).to_pylist() for c in ("term", "docs", "impacts", "ends", "tops")]
        for term, docs, *others in zip(*rows, strict=True):
            if term:
                lists[term] = tuple(np.frombuffer(x, "<i4") for x in (docs, *others))
            else:
                ids = np.frombuffer(docs, "<i8")
        found = list(search_shard(lists, ids, items, by_term, k))
        item, doc, score = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"item": pa.array(item, pa.int64()), "doc_id": pa.array([None if d == NULL_ID else d for d in doc], pa.int64()), "score": pa.array(score, pa.int64())})

    lists = index.drop("n", "documents").join(F.broadcast(every), "term", "left_semi")
    return lists.groupBy("shard").applyInArrow(run, "item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index ``docs`` and search them for every item."""
    return search(build_index(docs), items, k)


#: The ranking of ``documents`` for each item of ``benchmark`` in DuckDB.
SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS size FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // size)))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
