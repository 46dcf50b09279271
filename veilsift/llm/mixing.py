"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

#: What ``mix`` adds to the documents.
COLUMNS = ("__topic", "__tokens", "__probability", "__kept", "__error")

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = 1
_LETTERS[128:] = 1


class TopicModel:
    """Spherical k-means over hashed word counts; a topic is the nearest centre by cosine."""

    def __init__(self, centres: np.ndarray, weights: np.ndarray):
        self.centres, self.weights = centres, weights

    @staticmethod
    def features(texts: list[bytes], dims: int) -> np.ndarray:
        h, own = shingles.runs(texts, _LETTERS)[:2]
        spots = own * dims + ((h >> np.uint64(40)).astype(np.int64) % dims)
        return np.log1p(np.bincount(spots, minlength=len(texts) * dims).reshape(len(texts), dims).astype(np.float32))

    def directions(self, counts: np.ndarray) -> np.ndarray:
        """Weighted rows of length 1; a row without weight stays zero."""
        x = counts * self.weights
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def moved(self, sums: np.ndarray) -> TopicModel:
        """The model with centres at the directions of the sums; a centre without documents stays."""
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        return TopicModel(np.where(size > 0, sums / np.maximum(size, 1e-12), self.centres).astype(np.float32), self.weights)

    def assign(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 256):
            counts = self.features(texts[at : at + 256], len(self.weights))
            out.append(((counts * self.weights) @ self.centres.T).argmax(axis=1))
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _features(docs: DataFrame, dims: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, spots, counts) of every row: the dimensions that a text reaches (16 bits) and their counts (32 bits)."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 256):
            rows = TopicModel.features(batch.column(1).cast(pa.binary()).to_pylist(), dims)
            spots = [np.flatnonzero(r).astype(np.uint16) for r in rows]
            counts = [r[i].tobytes() for r, i in zip(rows, spots, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "spots": pa.array([i.tobytes() for i in spots], pa.binary()), "counts": pa.array(counts, pa.binary())})

    return plain.mapInArrow(count, "doc_id long, spots binary, counts binary")


def _dense(spots: list[bytes], counts: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(spots), dims), np.float32)
    own = np.repeat(np.arange(len(spots)), [len(i) // 2 for i in spots])
    out[own, np.frombuffer(b"".join(spots), np.uint16)] = np.frombuffer(b"".join(counts), np.float32)
    return out


def _summed(rows: DataFrame, dims: int, step) -> np.ndarray:
    """What ``step`` adds up over the counts of all rows: ``step(None)`` is zero, ``step(counts)`` a block's part.

    A task gives one row; rows of tasks are added on executors first, so the driver gets a few sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = step(None)
        for batch in common.slices(batches, 256):
            total = total + step(_dense(*(batch.column(i).to_pylist() for i in (0, 1)), dims))
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("spots", "counts").mapInArrow(run, "part binary").rdd.map(lambda r: np.frombuffer(r["part"], np.float64))
    return parts.treeReduce(lambda x, y: x + y) if parts.getNumPartitions() else step(None)


def fit_topics(docs: DataFrame, topics: int = 8, dims: int = 1024, seeds: int = 4000, rounds: int = 20, tolerance: float = 1e-3, id_col: str = "doc_id", text_col: str = "text") -> TopicModel:
    """Spherical k-means over all rows: document frequencies and each round's centres are sums over all of them.

    Rounds end when no coordinate of a centre moves by more than ``tolerance``. The ``seeds`` documents
    with the smallest hash of doc_id give the places to start from only.
    """
    rows = common.stored(_features(docs, dims, id_col, text_col), "features")
    zero = np.zeros(dims + 1)
    seen = _summed(rows, dims, lambda c: zero if c is None else np.append((c > 0).sum(axis=0), len(c)).astype(np.float64))
    weights = np.log((seen[-1] + 1) / (seen[:-1] + 1)).astype(np.float32)
    model = TopicModel(_start(rows, topics, weights, seeds), weights)
    for _ in range(rounds):

        def sums(counts: np.ndarray | None, own: TopicModel = model) -> np.ndarray:
            if counts is None:
                return np.zeros(own.centres.size)
            x = own.directions(counts)
            near = (x @ own.centres.T).argmax(axis=1)
            return ((np.arange(len(own.centres))[:, None] == near).astype(np.float32) @ x).astype(np.float64).reshape(-1)

        before, model = model, model.moved(_summed(rows, dims, sums).reshape(model.centres.shape))
        if np.abs(model.centres - before.centres).max() <= tolerance:
            break
    common.forget(rows)
    return model


def _start(rows: DataFrame, topics: int, weights: np.ndarray, seeds: int) -> np.ndarray:
    """Centres to start from: those of the same method over the seeds alone."""
    dims = len(weights)
    ids = rows.select("doc_id").dropna()
    chosen = F.broadcast(ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(seeds))
    least = F.min(F.struct("spots", "counts")).alias("least")  # of a repeated doc_id
    found = rows.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("doc_id", "least.*").orderBy("doc_id").collect()
    x = TopicModel(np.zeros((1, dims), np.float32), weights).directions(_dense([r["spots"] for r in found], [r["counts"] for r in found], dims))
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((1, dims), np.float32)
    rng = np.random.default_rng(3)
    model = TopicModel(x[rng.choice(len(x), min(topics, len(x)), replace=False)], weights)
    for _ in range(20):
        near = (x @ model.centres.T).argmax(axis=1)
        model = model.moved((np.arange(len(model.centres))[:, None] == near).astype(np.float32) @ x)
    return model.centres


def with_topic(docs: DataFrame, model: TopicModel, text_col: str = "text", topic_col: str = "__topic", tokens_col: str = "__tokens") -> DataFrame:
    """``docs`` with the topic's number and the count of words as further columns; no row moves."""
    held = docs.sparkSession.sparkContext.broadcast((model.centres, model.weights))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TopicModel(*held.value)
        for batch in common.slices(batches):
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            topics, tokens = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for at, to in shingles.blocks(texts):
                topics.append(own.assign(texts[at:to]))
                tokens.append(np.bincount(shingles.words(texts[at:to])[1], minlength=to - at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(topics).astype(np.int32)), pa.array(np.concatenate(tokens).astype(np.int64))], [*batch.schema.names[:-1], topic_col, tokens_col])

    schema = docs.select("*", F.lit(0).alias(topic_col), F.lit(0).cast("long").alias(tokens_col)).schema
    return docs.select("*", common.text_or_empty(text_col).alias(topic_col)).mapInArrow(assign, schema)


def tempered(tokens: dict, power: float) -> dict:
    """Target shares in proportion to tokens**power: 1 keeps the mix, 0 makes it even."""
    scaled = {k: v**power for k, v in tokens.items() if v > 0}
    total = sum(scaled.values())
    return {k: v / total for k, v in scaled.items()}


def rake(keys: list[tuple], tokens: np.ndarray, targets: list[dict], budget: float, rounds: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Token weights of the cells that fit each dimension's target shares of ``budget``, never over a cell's tokens.

    Each round scales every dimension's slices to their targets in turn, then returns cells that grew
    over their tokens to them. Also gives the largest error of a marginal, as a share of the budget:
    over the tolerance when the targets cannot be met (empty cells, or too few tokens in a slice).
    """
    if not keys:
        return tokens, 0.0
    slots = []
    for d, target in enumerate(targets):
        names = {v: i for i, v in enumerate(sorted({k[d] for k in keys}, key=str))}
        goal = np.array([target.get(v, 0.0) for v in names]) * budget
        slots.append((np.array([names[k[d]] for k in keys], np.int64), goal))
    w, error = tokens * (budget / max(tokens.sum(), 1e-12)), 0.0
    for _ in range(rounds):
        for at, goal in slots:
            now = np.bincount(at, w, minlength=len(goal))
            w = w * np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)[at]
        w = np.minimum(w, tokens)
        error = max(np.abs(np.bincount(at, w, minlength=len(goal)) - goal).max() for at, goal in slots) / max(budget, 1e-12)
        if error < tolerance:
            break
    return w, float(error)


def missed(keys: list[tuple], weights: np.ndarray, targets: list[dict], budget: float, tolerance: float = 1e-3) -> list[tuple]:
    """(dimension, value, reached, wanted) tokens of each marginal that is off by more than ``tolerance`` of the budget."""
    out = []
    for d, target in enumerate(targets):
        reached: dict = dict.fromkeys(target, 0.0)
        for k, w in zip(keys, weights.tolist(), strict=True):
            reached[k[d]] = reached.get(k[d], 0.0) + w
        out += [(d, v, x, target.get(v, 0.0) * budget) for v, x in reached.items() if abs(x - target.get(v, 0.0) * budget) > tolerance * budget]
    return sorted(out, key=lambda r: -abs(r[2] - r[3]))


def mix(docs: DataFrame, share: float = 0.5, power: float = 0.7, topics: int = 8, targets: list[dict] | None = None, seed: int = 5, dims: tuple[str, str] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text", most_cells: int = 1_000_000) -> DataFrame:
    """``docs`` with ``__topic``, ``__tokens``, ``__probability``, ``__kept`` and ``__error``.

    Tokens are counted in cells of source x language x topic; token weights are raked to the target
    shares of each (by default the corpus's shares to the power ``power``) at ``share`` of all tokens;
    a document stays with its cell's calibrated probability, decided by a hash of its id and the seed,
    so expected tokens meet the targets where cells have the tokens for them. Where they have not, the cells
    give all they have, ``__error`` is the largest error of a marginal as a share of the budget (one number
    a run), and a warning names the marginals that miss their targets. The cell table has one row for each combination that occurs,
    not one a document; more than ``most_cells`` of them raise an error before any is collected.

    Null sources and languages are values of their own; a text without words has no tokens and takes
    its cell's probability; a null doc_id draws as one id; repeated rows draw alike; an empty table
    stays empty; a ``share`` of 1 keeps everything the targets allow. Where ``docs`` has a column of
    a new one's name, the new one takes a further underscore.
    """
    topic_col, tokens_col, chance_col, kept_col, error_col = common.own_names(docs, *COLUMNS)
    model = fit_topics(docs, topics, id_col=id_col, text_col=text_col)
    counted = with_topic(docs, model, text_col, topic_col, tokens_col)
    cell = [*dims, topic_col]
    table = common.stored(counted.groupBy(*cell).agg(F.sum(tokens_col).alias(tokens_col)), "cells")
    n = table.count()
    if n > most_cells:
        raise ValueError(f"{n} cells of source, language and topic; at most {most_cells} are raked on the driver")
    rows = table.orderBy(*cell).collect()
    keys, tokens = [tuple(r)[:3] for r in rows], np.array([r[tokens_col] for r in rows], float)
    if targets is None:
        targets = []
        for d in range(3):
            sums: dict = {}
            for k, v in zip(keys, tokens.tolist(), strict=True):
                sums[k[d]] = sums.get(k[d], 0.0) + v
            targets.append(tempered(sums, power))
    budget = share * tokens.sum()
    weights, error = rake(keys, tokens, targets, budget)
    off = missed(keys, weights, targets, budget)
    if off:
        said = ", ".join(f"{cell[d]} {v!r}: {x:.0f} of {goal:.0f} tokens" for d, v, x, goal in off[:20])
        warnings.warn(f"mixing reaches {weights.sum():.0f} of {budget:.0f} tokens and misses {len(off)} targets: {said}", stacklevel=2)
    chance = np.divide(weights, tokens, out=np.full(len(tokens), float(share)), where=tokens > 0)
    fields = table.select(*cell).schema
    schema = fields.add(chance_col, "double")
    probabilities = docs.sparkSession.createDataFrame([(*k, float(p)) for k, p in zip(keys, chance, strict=True)], schema)
    spots = common.own_names(counted, "cell_0", "cell_1", "cell_2")
    named = probabilities.select(*[F.col(c).alias(spot) for c, spot in zip(cell, spots, strict=True)], chance_col)
    same = [counted[c].eqNullSafe(named[spot]) for c, spot in zip(cell, spots, strict=True)]
    draw = F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") * 2.0**-53
    # at most `most_cells` short rows
    joined = counted.join(F.broadcast(named), same, "left").drop(*spots)
    return joined.withColumn(kept_col, draw < F.coalesce(chance_col, F.lit(float(share)))).withColumn(error_col, F.lit(error))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with the columns of ``docs``; null, empty, repeated and missing rows as in ``mix``."""
    kept = common.own_names(docs, *COLUMNS)[3]
    return mix(docs, **options).where(F.col(kept)).select(*docs.columns)
