"""Toxicity from nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_WORDS = re.compile(r"[^\W\d_]+")
#: Lengths of word prefixes that are terms beside whole words: inflected and compounded forms share them.
PREFIXES = (4, 5, 6, 7, 8)
#: Documents of the index in one block.
BLOCK = 32


def terms(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


class Features(dict):
    """Numbers of a word's terms within the feature space, found once a word; bounded by ``room``."""

    def __init__(self, space: dict[str, int], room: int = 150_000):
        super().__init__()
        self.space, self.room = space, room

    def __missing__(self, word: str) -> tuple[int, ...]:
        self[word] = found = tuple(i for t in terms(word) if (i := self.space.get(t)) is not None)
        return found

    def counts(self, text: str) -> Counter:
        """Occurrences of each feature in the whole text."""
        if len(self) > self.room:
            self.clear()
        out: Counter = Counter()
        for found in filter(None, map(self.__getitem__, _WORDS.findall(text.lower()))):
            out.update(found)
        return out


class BlockMaxIndex:
    """Unit TF-IDF vectors of the labelled examples, in blocks with each feature's largest weight.

    A query's bound for a block is the sum of its weights times those maxima. Blocks are scored in
    full from the largest bound down, until the bound falls to the k-th best cosine: what is left
    cannot enter the top k, so the top k is exact. Ties go to the smaller number.
    """

    def __init__(self, vectors: list[dict[int, float]], features: int):
        self.n = len(vectors)
        blocks = -(-self.n // BLOCK)
        self.bound: list[dict[int, float]] = [{} for _ in range(features)]
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in range(blocks):
            part = vectors[b * BLOCK : (b + 1) * BLOCK]
            at = np.repeat(np.arange(len(part)), [len(v) for v in part])
            spot = np.array([f for v in part for f in v], np.int64)
            weight = np.array([w for v in part for w in v.values()])
            self.rows.append((at, spot, weight))
            for v in part:
                for f, w in v.items():
                    if w > self.bound[f].get(b, 0.0):
                        self.bound[f][b] = w
        self.posts = [(np.array(list(x), np.int64), np.array(list(x.values()))) for x in self.bound]
        self.scratch = np.zeros(features)
        self.blocks = blocks

    def top(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k largest cosines above 0 as (cosine, number), largest first; ``without`` leaves one example out."""
        if not query or not self.n:
            return []
        bounds = np.zeros(self.blocks)
        for f, w in query.items():
            at, most = self.posts[f]
            bounds[at] += w * most
            self.scratch[f] = w
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(best) == k and bounds[b] < best[0][0] - 1e-12):
                break
            at, spot, weight = self.rows[b]
            scores = np.bincount(at, self.scratch[spot] * weight, minlength=BLOCK)
            for i in np.flatnonzero(scores > 0).tolist():
                number = b * BLOCK + i
                if number == without:
                    continue
                entry = (float(scores[i]), -number)
                if len(best) < k:
                    heappush(best, entry)
                elif entry > best[0]:
                    heapreplace(best, entry)
        for f in query:
            self.scratch[f] = 0.0
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def brute_force_top(vectors: list[dict[int, float]], query: dict[int, float], k: int) -> list[tuple[float, int]]:
    scores = [(sum(w * v.get(f, 0.0) for f, w in query.items()), i) for i, v in enumerate(vectors)]
    return sorted(((s, i) for s, i in scores if s > 0), key=lambda x: (-x[0], x[1]))[:k]


def unit(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    raw = {f: (1 + math.log(n)) * float(idf[f]) for f, n in sorted(counts.items())}
    size = math.sqrt(sum(w * w for w in raw.values()))
    return {f: w / size for f, w in raw.items()} if size else {}


def vote(near: list[tuple[float, int]], labels: np.ndarray, weight: np.ndarray, prior: float) -> float:
    """Share of toxic neighbours, weighted by squared cosine and class weight, drawn to the prior when neighbours are far."""
    up, total = 0.05 * prior, 0.05
    for s, i in near:
        w = s * s * weight[i]
        up += w * labels[i]
        total += w
    return up / total


class Calibration:
    """Monotone map from votes to the share of toxic rows (pool-adjacent-violators on weighted rows)."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, weight: np.ndarray):
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []
        for v, y, w in zip(votes[order].tolist(), labels[order].tolist(), weight[order].tolist(), strict=True):
            pools.append([w * y, w, v, v])
            while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
                a = pools.pop()
                pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
        self.x = [(p[2] + p[3]) / 2 for p in pools]
        self.y = [p[0] / p[1] for p in pools]

    def __call__(self, v: float) -> float:
        level = float(np.interp(v, self.x, self.y)) if self.x else v
        return min(1.0, max(0.0, 0.98 * level + 0.02 * v))


class ToxicModel:
    def __init__(self, space: dict[str, int], idf: np.ndarray, vectors: list[dict[int, float]], ids: list[int], labels: np.ndarray, rate: float, k: int = 15):
        self.idf, self.labels, self.ids, self.rate, self.k = idf, labels, ids, rate, k
        self.features = Features(space)
        self.index = BlockMaxIndex(vectors, len(space))
        share = labels.mean() if len(labels) else 0.0
        # examples are drawn evenly from both labels; weights bring back the labelled rows' rate
        self.weight = np.where(labels == 1, rate / share, (1 - rate) / (1 - share)) if 0 < share < 1 else np.ones(len(labels))
        votes = np.array([vote(self.index.top(v, k, without=i), labels, self.weight, rate) for i, v in enumerate(vectors)])
        self.calibration = Calibration(votes, labels, self.weight) if 0 < share < 1 else Calibration(np.empty(0), labels[:0], self.weight[:0])

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.top(unit(self.features.counts(text), self.idf), self.k)
        return self.calibration(vote(near, self.labels, self.weight, self.rate)), near


def examples(labels: DataFrame, per_label: int, folds: bool, id_col: str = "doc_id", label_col: str = "toxic") -> tuple[DataFrame, float]:
    """Up to ``per_label`` ids of each label with the smallest hashes (the documented bound), and the toxic rate.

    With ``folds``, rows whose crc32(doc_id as text) mod 5 is 0 are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(common.crc_fold("doc_id") != 0) if folds else known
    rate = known.agg(F.avg("toxic")).first()[0] or 0.0
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (1, 0)]
    return parts[0].unionByName(parts[1]), float(rate)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, most_features: int = 20_000, folds: bool = True, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Feature space and index from bounded labelled examples, document frequencies from all documents.

    The space holds the terms that part toxic from other examples best: words and word prefixes with a
    document count of 4 at least among the examples and odds of 3 at least either way.
    """
    spark = docs.sparkSession
    chosen, rate = examples(labels, per_label, folds, id_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    # a repeated doc_id stands for the smallest of its texts
    sample = common.stored(plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "examples")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted({t for w in set(_WORDS.findall(text.lower())) for t in terms(w)})
                yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.string()), "toxic": pa.array([toxic] * len(found), pa.int32())})

    counts = sample.select("text", "toxic").mapInArrow(spell, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    up, down = sizes.get(1, 0) + 1.0, sizes.get(0, 0) + 1.0
    odds = F.log((F.col("a") + 0.5) / F.lit(up)) - F.log((F.col("b") + 0.5) / F.lit(down))
    ranked = counts.where("a + b >= 4").withColumn("odds", odds).where(F.abs("odds") >= math.log(3)).withColumn("gain", F.abs("odds") * F.sqrt(F.col("a") + F.col("b")))
    kept = ranked.orderBy(F.desc("gain"), "term").limit(most_features).select("term").collect() if len(sizes) == 2 else []
    space = {r["term"]: i for i, r in enumerate(kept)}
    held = spark.sparkContext.broadcast(space)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, n = Features(held.value), np.zeros(len(held.value) + 1, np.int64), 0
        for batch in common.slices(batches):
            for text in batch.column(0).to_pylist():
                found = own.counts(text)
                if found:
                    total[list(found)] += 1
            n += batch.num_rows
        total[-1] = n
        spots = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(spots, pa.int64()), "n": pa.array(total[spots], pa.int64())})

    df = np.zeros(len(space) + 1)
    for r in plain.select("text").mapInArrow(seen, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(held.value)
        for batch in batches:
            rows = [own.counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "toxic": batch.column(2), "spots": pa.array([sorted(r) for r in rows], pa.list_(pa.int64())), "counts": pa.array([[r[f] for f in sorted(r)] for r in rows], pa.list_(pa.int64()))})

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(vectors, "doc_id long, toxic int, spots array<long>, counts array<long>").collect()
    # examples with the same strongest feature lie side by side, which sharpens the blocks' bounds
    rows.sort(key=lambda r: (min(r["spots"], default=-1), r["doc_id"]))
    units = [unit(dict(zip(r["spots"], r["counts"], strict=True)), idf) for r in rows]
    common.forget(sample)
    return ToxicModel(space, idf, units, [r["doc_id"] for r in rows], np.array([r["toxic"] for r in rows], np.int64), rate)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, evidence.

    The score is the calibrated vote of the nearest labelled examples by exact TF-IDF cosine over the
    whole text; evidence lists the three nearest as (doc_id, similarity, toxic). A text without any
    feature (null and empty ones too) scores what such examples did. Null doc_ids stay null and are not
    held out; repeated rows score alike; an empty table gives no rows; without labels of both kinds
    every score is the labelled rate; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **fitting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in common.slices(batches):
            scores, evidence = [], []
            for text in batch.column(1).to_pylist():
                s, near = own.score(text)
                scores.append(s)
                evidence.append([{"doc_id": own.ids[i], "similarity": c, "toxic": int(own.labels[i])} for c, i in near[:3]])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64()), "evidence": pa.array(evidence, kind)})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    scored = plain.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, similarity: double, toxic: int>>")
    held_out = F.coalesce(common.crc_fold("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
