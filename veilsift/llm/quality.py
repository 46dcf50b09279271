"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

U = np.uint64

#: Byte classes of tokens: letters, digits and all bytes of other alphabets; the rest is punctuation.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def ngrams(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each hashed n-gram.

    Token unigrams, and bigrams of token forms: class, capitals, length, whether the token equals one
    of the two before it, and for punctuation the run itself. Words make most unigrams of open
    vocabularies rare; forms carry over to unseen words.
    """
    h, own, place, length, kind = shingles.runs(texts, _CLASS)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals = upper[place + length] - upper[place]
    caps = np.where(capitals == 0, 0, np.where(capitals == length, 2, 1)) * (length > 1) + (length == 1) * 3
    same = np.zeros(len(h), bool)
    for k in (1, 2):
        same[k:] |= (h[k:] == h[:-k]) & (own[k:] == own[:-k])
    form = np.where(kind == 2, h, (kind * 4 + caps).astype(np.uint64) * U(64) + np.minimum(length, 15).astype(np.uint64) * U(2) + same)
    form = shingles.mix(form + U(77))
    pair = shingles.mix(form[:-1] * U(3) + form[1:])[own[1:] == own[:-1]]
    spots = np.concatenate([h, pair])
    return (spots >> U(40)).astype(np.int64) % buckets, np.concatenate([own, own[1:][own[1:] == own[:-1]]])


class Model:
    """Log ratio of an n-gram's probability in target and raw text, for each hash bucket."""

    def __init__(self, target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0):
        p = (target + smoothing) / (target.sum() + smoothing * len(target))
        q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
        self.log_ratio = np.log(p) - np.log(q)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Log importance weight of each text: the sum over its n-grams; 0 for a text without any."""
        spots, own = ngrams(texts, len(self.log_ratio))
        return np.bincount(own, self.log_ratio[spots], minlength=len(texts))


def sampled_labels(labels: DataFrame, sample: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, good) of the ``sample`` labelled ids with the smallest hashes: the documented bound of what is fitted."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).dropna()
    return known.groupBy("doc_id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, chosen: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The raw model counts every document, the target model those that ``chosen`` marks good.

    ``chosen`` is broadcast (see sampled_labels); counts come back as ``buckets`` numbers. Without
    any good document all weights are 0.
    """
    good = F.broadcast(chosen.where("good = 1").select("doc_id", F.lit(1).alias("good")))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    marked = plain.join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in common.slices(batches):
            texts, good = batch.column(0).cast(pa.binary()).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for at, to in shingles.blocks(texts):
                spots, own = ngrams(texts[at:to], buckets)
                total[0] += np.bincount(spots, minlength=buckets)
                total[1] += np.bincount(spots[good[at:to][own]], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(buckets, dtype=np.int32)), "raw": total[0], "target": total[1]})

    counts = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return Model(target, raw) if target.any() else Model(raw, raw)


def with_weights(docs: DataFrame, model: Model, text_col: str = "text", weight_col: str = "__log_weight") -> DataFrame:
    """``docs`` with the log importance weight as a further column; no row moves."""
    log_ratio = docs.sparkSession.sparkContext.broadcast(model.log_ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.log_ratio = log_ratio.value
        for batch in common.slices(batches):
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            weights = np.concatenate([own.score(texts[at:to]) for at, to in shingles.blocks(texts)] or [np.empty(0)])
            columns = [*batch.columns[:-1], pa.array(weights, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], weight_col])

    schema = docs.select("*", F.lit(0.0).alias(weight_col)).schema
    return docs.select("*", common.text_or_empty(text_col).alias(weight_col)).mapInArrow(score, schema)


def gumbel(id_col: str, seed: int):
    """Standard Gumbel noise, a function of the document's id and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") + 0.5) * 2.0**-53
    return -F.log(-F.log(u))


def strata(weights: np.ndarray, good: np.ndarray, most: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Bounds between strata of labelled weights (even in rows, at most ``most``), and each one's share of good rows."""
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order].astype(float)
    spots = np.unique(np.linspace(0, len(weights), min(most, len(weights)) + 1).astype(int))[1:-1]
    spots = spots[weights[spots] > weights[spots - 1]]  # ties stay together
    bounds = (weights[spots] + weights[spots - 1]) / 2
    shares = np.array([part.mean() for part in np.split(good, spots)])
    return bounds, shares


def target_rows(keys: DataFrame, bounds: np.ndarray, shares: np.ndarray, weight_col: str = "log_weight") -> int:
    """The expected number of good rows in the whole table: rows of each stratum times its share of good ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shares), np.int64)
        for batch in batches:
            total += np.bincount(np.searchsorted(bounds, batch.column(0).to_numpy(), side="right"), minlength=len(shares))
        yield pa.RecordBatch.from_pydict({"stratum": pa.array(np.arange(len(shares), dtype=np.int32)), "n": total})

    rows = keys.select(weight_col).mapInArrow(count, "stratum int, n long").groupBy("stratum").agg(F.sum("n").alias("n")).collect()
    return round(sum(r["n"] * shares[r["stratum"]] for r in rows))


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, temperature: float = 1.0, seed: int = 11, sample: int = 20_000, buckets: int = 65_536, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` with ``__log_weight``, ``__gumbel_key`` and ``__kept``: Gumbel top-k of importance weights.

    The k largest of log weight + temperature * Gumbel noise are k documents sampled without
    replacement in proportion to weights**(1/temperature). k is the share ``keep`` of all rows; by
    default, the expected number of good documents in the whole table: its rows in each stratum of
    log weights, times the share of good rows among the labelled ones there (at most ``sample``). The
    k-th key is found exactly by counting; rows tied with it all stay.

    Null and empty texts have log weight 0; a null doc_id takes noise of its own; repeated rows get
    equal keys; an empty table stays empty; without labels of both kinds every row stays. Where
    ``docs`` has a column of a new one's name, the new one takes a further underscore.
    """
    weight_col, key_col, kept_col = common.own_names(docs, "__log_weight", "__gumbel_key", "__kept")
    chosen = sampled_labels(labels, sample, id_col, label_col)
    model = fit(docs, chosen, buckets, id_col, text_col)
    scored = with_weights(docs, model, text_col, weight_col).withColumn(key_col, F.col(weight_col) + F.lit(temperature) * gumbel(id_col, seed))
    keys = common.stored(scored.select(F.col(id_col).cast("long").alias("doc_id"), F.col(weight_col).alias("log_weight"), F.col(key_col).alias("gumbel_key")), "gumbel-keys")
    n = k = keys.count()
    if keep is None:
        least_weight = F.min("log_weight").alias("log_weight")  # of a repeated doc_id
        known = keys.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(least_weight, F.max("good").alias("good"))
        known = known.orderBy("doc_id").toPandas()  # at most `sample` rows
        if known["good"].nunique() == 2:
            k = min(n, target_rows(keys, *strata(known["log_weight"].to_numpy(), known["good"].to_numpy())))
    else:
        k = min(n, round(n * keep))
    least = common.nth_smallest(keys, "gumbel_key", n - k + 1) if k else None
    common.forget(keys)
    kept = F.col(key_col) >= F.lit(least) if least is not None else F.lit(False)
    return scored.withColumn(kept_col, kept)


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that stay, with the columns of ``docs``; null, empty, repeated and missing rows as in ``resample``."""
    *_, kept = common.own_names(docs, "__log_weight", "__gumbel_key", "__kept")
    return resample(docs, labels, **options).where(F.col(kept)).select(*docs.columns)
