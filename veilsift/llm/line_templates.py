"""Line deduplication with a log-template tree.

A unit is a line, or each sentence of a line longer than LONG words. The tree routes a unit by its
token count and its leading tokens to a leaf; a leaf's templates keep each token or a wildcard, and
tokens with digits are wildcards always. Log parsers merge a leaf's lines one after another, which
depends on their order and grows with the square of a leaf; here a unit belongs to one template with
all its plain tokens and, when it is long enough, to four more in which one quarter of the tokens
after the leading ones is a run of wildcards. Units that differ in the fields of one quarter share a
template, whatever their order, and the work is linear. A template is a 64-bit hash of its path and
tokens, taken for all units of many texts by prefix sums.

A template that occurs in several documents recurs; its units are dropped from all of them but the
document with the smallest id (or from all).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, shingles

#: Lines with more words than this are cut into sentences.
LONG = 40
#: Leading tokens that are part of a unit's path in the tree.
DEPTH = 2
#: Units with fewer words are dropped only as sentences between two recurring neighbours.
LEAST_WORDS = 5
#: Units with fewer words have no template with a wildcard run.
LEAST_RUN_WORDS = 12

U = np.uint64
_WORD = np.ones(256, np.uint8)
_WORD[[32, 9, 10, 11, 12, 13]] = 0
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_FIELD = U(0x5EED)


class Units:
    """The units of some texts: text number, place of the first byte, words, and their number in the text."""

    def __init__(self, texts: list[bytes]):
        self.h, own, place, length, _ = shingles.runs(texts, _WORD)
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        self.h = np.where(digits[place + length] > digits[place], _FIELD, self.h)
        line = np.cumsum(data == 10)[place] if len(place) else place
        turns = np.ones(len(place), bool)
        turns[1:] = (own[1:] != own[:-1]) | (line[1:] != line[:-1])
        number = np.cumsum(turns) - 1
        long_line = (np.bincount(number) > LONG)[number] if len(number) else turns
        turns[1:] |= long_line[1:] & _ENDS[data[place + length - 1]][:-1]
        self.first = np.flatnonzero(turns)
        self.words = np.diff(np.concatenate([self.first, [len(place)]]))
        self.own, self.place, self.line = own[self.first], place[self.first], line[self.first]
        opens = np.ones(len(self.first), bool)
        opens[1:] = self.own[1:] != self.own[:-1]
        starts = np.flatnonzero(opens)
        self.number = np.arange(len(self.first)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(self.first)]])))

    def templates(self) -> tuple[np.ndarray, np.ndarray]:
        """(unit, hash) of every template."""
        n, first = self.words, self.first
        shingles._grow(len(self.h) + 1)
        total = np.zeros(len(self.h) + 1, np.uint64)
        np.cumsum(self.h * shingles._powers[: len(self.h)], out=total[1:])
        span = lambda a, b, at: (total[b] - total[a]) * shingles._inverse[at]
        path = shingles.mix(n.astype(np.uint64))
        whole = np.flatnonzero(n >= LEAST_WORDS)
        units, sigs = [whole], [shingles.mix(span(first, first + n, first) + path)[whole]]
        runs = np.flatnonzero(n >= LEAST_RUN_WORDS)
        at, m = first[runs], n[runs]
        everything = span(at, at + m, at)
        for i in range(4):
            a, b = at + DEPTH + (m - DEPTH) * i // 4, at + DEPTH + (m - DEPTH) * (i + 1) // 4
            units.append(runs)
            sigs.append(shingles.mix(shingles.mix(everything - span(a, b, at) + U(i + 1)) + path[runs]))
        # a short sentence goes where it recurs between the same neighbours of its line
        inner = np.arange(1, len(n) - 1)
        same = lambda x: (x[inner - 1] == x[inner]) & (x[inner + 1] == x[inner])
        short = inner[(n[inner] < LEAST_WORDS) & same(self.own) & same(self.line)]
        at, to = first[short - 1], first[short + 1] + n[short + 1]
        units.append(short)
        sigs.append(shingles.mix(shingles.mix(span(at, to, at) + path[short] + U(5)) + path[short - 1] + path[short + 1] * U(3)))
        return np.concatenate(units), np.concatenate(sigs)


def _parse(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, unit, sig) for every template of every unit; th tells texts of a repeated doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for at, to in shingles.blocks(texts):
                units = Units(texts[at:to])
                which, sigs = units.templates()
                spot = at + units.own[which]
                yield pa.RecordBatch.from_arrays([pa.array(ids[spot]), pa.array(hashes[spot]), pa.array(units.number[which].astype(np.int32)), pa.array(sigs.view(np.int64))], ["doc_id", "th", "unit", "sig"])

    text = common.text_or_empty(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text), text).where("doc_id is not null")
    return plain.mapInArrow(run, "doc_id long, th long, unit int, sig long")


def recurring(parsed: DataFrame, min_docs: int) -> DataFrame:
    """(sig, first, rows): templates found in ``min_docs`` documents at least, and the smallest doc_id with each."""
    per = parsed.groupBy("sig").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    per = per.where("first <> last")
    if min_docs > 2:  # only what recurs is counted by document
        many = parsed.select("sig", "doc_id").join(per.where(F.col("rows") >= min_docs).select("sig"), "sig").distinct()
        per = per.join(many.groupBy("sig").count().where(F.col("count") >= min_docs).select("sig"), "sig")
    return per.select("sig", "first", "rows")


def without(text: bytes, gone: set[int]) -> bytes:
    """The text without the units of the given numbers; each takes the white space up to the next one with it."""
    starts = Units([text]).place.tolist()
    cuts = [*starts, len(text)]
    kept = [text[: cuts[0]]] + [text[cuts[i] : cuts[i + 1]] for i in range(len(starts)) if i not in gone]
    return b"".join(kept).rstrip(b"\n")


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with units of recurring templates dropped from ``text_col``, and ``__dropped``, how many.

    With ``keep_first`` the document with the smallest id keeps a recurring template's units, so
    content that exact or near copies share stays once. Units of under LEAST_WORDS words
    stay, but for sentences that recur between the same two sentences of their line. A null
    text stays null; rows with a null doc_id neither count nor lose units; rows that share a doc_id
    count as one document and keep what is first in it; an empty table stays empty. A document may
    lose all its text. Where ``docs`` has a column ``__dropped``, the new one takes a further underscore.
    """
    dropped_col, th_col, drop_col = common.own_names(docs, "__dropped", "__th", "__drop")
    parsed = common.stored(_parse(docs, id_col, text_col), "templates")
    again = common.stored(recurring(parsed, min_docs), "recurring")
    hits = graph.look_up(parsed, again, ["sig"], "rows", parsed.count())
    if keep_first:
        hits = hits.where(F.col("doc_id") != F.col("first"))
    drops = hits.groupBy(F.col("doc_id").alias("id"), "th").agg(F.collect_set("unit").alias(drop_col))
    keyed = docs.withColumn(th_col, F.xxhash64(common.text_or_empty(text_col)))
    joined = keyed.join(drops.hint("shuffle_hash"), (keyed[id_col].cast("long") == drops["id"]) & (keyed[th_col] == drops["th"]), "left").select(docs["*"], drops[drop_col])
    joined = joined.withColumn(text_col, F.col(text_col).cast("string"))
    spot = docs.columns.index(text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            drops = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(spot)
            if any(drops):
                plain = texts.cast(pa.binary()).to_pylist()
                texts = pa.array([without(t, set(d)) if d else t for t, d in zip(plain, drops, strict=True)], pa.binary()).cast(pa.string())
            columns = [texts if i == spot else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(d or ()) for d in drops], pa.int32())], [*batch.schema.names[:-1], dropped_col])

    return joined.mapInArrow(rebuild, joined.drop(drop_col).select("*", F.lit(0).alias(dropped_col)).schema)


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents with text left, with the columns of ``docs``; ``n_chars`` follows the text where it is a column.

    Rows whose text was null or blank before stay; null, repeated and missing rows are as in ``dedup_lines``.
    """
    (dropped,) = common.own_names(docs, "__dropped")
    out = dedup_lines(docs, id_col=id_col, text_col=text_col, **options)
    out = out.where((F.col(dropped) == 0) | (F.trim(F.col(text_col)) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
