"""What each of five filters removes, keeps and costs, in every order of the filters.

Texts are measured over Arrow's own buffers: one table look-up classes every byte, prefix sums at the
texts' offsets count words, capitals, symbols and code points, and sorted hashes of the words, verified
on their bytes, count the distinct ones. What a text fails becomes a mask of five bits; counts of masks
are all that the orders need, so the 120 orders cost nothing that grows with the rows.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

#: The filters, by the bit that a failure sets.
FILTERS = "ABCDE"

MEASURES = ["words", "distinct_words", "capitals", "symbols", "characters"]

SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8


def _classes() -> np.ndarray:
    """The classes of all 256 bytes; INNER bytes continue a code point of UTF-8."""
    out = np.zeros(256, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] |= SPACE
    out[ord("A") : ord("Z") + 1] |= CAPITAL
    out[list(b"#$%&*|")] |= SYMBOL
    out[0x80:0xC0] |= INNER
    return out


CLASSES = _classes()
def same_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words ``a[i]`` and ``b[i]`` have the same bytes."""
    eights, same = shingles.loads(data), lengths[a] == lengths[b]
    rest = np.flatnonzero(same & (lengths[a] <= shingles.LONG_WORD))
    at = 0
    while len(rest):
        differing = (eights[starts[a[rest]] + at] ^ eights[starts[b[rest]] + at]) & shingles.LOW[np.minimum(lengths[a[rest]] - at, 8)]
        same[rest[differing != 0]] = False
        at += 8
        rest = rest[(differing == 0) & (lengths[a[rest]] > at)]
    for i in np.flatnonzero(same & (lengths[a] > shingles.LONG_WORD)):
        x, y, n = starts[a[i]], starts[b[i]], lengths[a[i]]
        same[i] = np.array_equal(data[x : x + n], data[y : y + n])
    return same


def measure(texts: pa.Array) -> list[np.ndarray]:
    """MEASURES of each text (no nulls), as arrays."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    _, offsets, values = texts.buffers()
    ends = np.frombuffer(offsets, width, n + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8)[ends[0] : ends[-1]] if values is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    classes = CLASSES[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[ends[1:]] - sums[ends[:-1]]

    inside = (classes & SPACE) == 0
    filled = ends[1:] > ends[:-1]
    before = np.concatenate([[False], inside[:-1]])[: len(data)]
    before[ends[:-1][filled]] = False
    after = np.concatenate([inside[1:], [False]])[: len(data)]
    after[ends[1:][filled] - 1] = False
    begins = inside & ~before
    words = per_text(begins)
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    return [words, _distinct(data, starts, lengths, words), per_text((classes & CAPITAL) != 0), per_text((classes & SYMBOL) != 0), per_text((classes & INNER) == 0)]


def _distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Distinct words of each text: runs of equal (text, 48 bits of hash), each run verified on its bytes.

    A text with a run of differing words, whose hashes collide, is counted by a set of its words.
    """
    owner = np.repeat(np.arange(len(words), dtype=np.uint64), words)
    key = owner << np.uint64(48) | shingles.word_hashes(data, starts, lengths) >> np.uint64(16)
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1]) + 1 if len(key) else np.zeros(0, np.int64)
    out = words - np.bincount(owner[order[again]].astype(np.int64), minlength=len(words))
    wrong = ~same_words(data, starts, lengths, order[again - 1], order[again])
    first = np.concatenate([[0], np.cumsum(words)])
    for i in np.unique(owner[order[again[wrong]]].astype(np.int64)):
        mine = slice(first[i], first[i + 1])
        out[i] = len({data[s : s + n].tobytes() for s, n in zip(starts[mine], lengths[mine], strict=True)})
    return out


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with MEASURES in place of the text; a null text is empty.

    Words are maximal runs of anything but the bytes 09 to 0D and 20, case-sensitive; characters are
    code points. Rows go through in slices of at most 512 texts.
    """
    kept = [c for c in docs.columns if c != text_col]
    names = common.own_names(docs.select(*kept), *MEASURES)
    plain = docs.select(*kept, common.text_or_empty(text_col).alias(common.own_names(docs, "__text")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(x, pa.int64()) for x in measure(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays(columns, kept + names)

    schema = plain.select(*kept).schema
    for name in names:
        schema = schema.add(name, "long")
    return plain.mapInArrow(run, schema)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows that agree in id, text and part: doc_id, part, sha, mask of the filters A to D, n rows."""
    sha = F.unhex(F.sha2(common.text_or_empty(text_col).cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), sha.alias("sha"), F.col(text_col).alias("text"))
    m = measured(rows)
    tests = [F.col("words") < 200, 100 * F.col("distinct_words") < 50 * F.col("words"), 100 * F.col("capitals") > 3 * F.col("characters"), F.col("symbols") > 0]
    mask = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    return m.select("doc_id", "part", "sha", mask.alias("mask")).groupBy("doc_id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n"))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows of each part and mask of failures: part, mask, n, good (quality 1), toxic (toxic 1).

    Bit i of a mask stands for FILTERS[i]. E fails where a smaller id has the same text: of the rows of
    a text (grouped by its sha256, summed before any shuffle), all but those with the smallest id.
    Null ids are neither smaller nor larger than others, so their rows neither fail E nor make others
    fail. A repeated label id counts by its largest quality and toxic; ids without labels are neither.
    """
    found = failures(docs, id_col, text_col, part_col)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # null ids get keys that no label has, each text its own, so that they do not gather in one task
    keyed = found.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.hex("sha"))))
    labelled = keyed.join(known, "key", "left").na.fill(False, ["good", "toxic"])
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    same = ["sha", "part", "mask", "good", "toxic"]
    # rows of one id may hold the same text twice, in several parts: first the rows of each id, then of each text
    ids = labelled.groupBy(*same, "doc_id").agg(F.sum("n").alias("n"))
    groups = ids.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nulls"), least.alias("least"))
    smallest = groups.groupBy("sha").agg(F.min("least.doc_id").alias("first"))
    both = groups.join(smallest, "sha")
    at_first = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    kept = F.col("nulls") + at_first
    spread = both.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n")))).alias("x"))
    rows = spread.select("part", "x.mask", "x.n", "good", "toxic").where("n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """Each step of each order: the order, the step from 1, the bits of the filters before it, its own bit."""
    out = []
    for p in itertools.permutations(FILTERS):
        before = 0
        for i, f in enumerate(p):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(p), i + 1, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Every step of every order of the filters in every part, zeros included.

    part, filter_order, step; kept (rows left after this step), removed (here), redundant (fail this
    filter, gone before), unique_fails (fail this filter only), good_lost and toxic_lost (removed here,
    by label), shapley (this filter's removed rows over all 120 orders: a mask of m failures goes to
    each of them in 120 / m orders). A null part is the empty string; no rows give no parts.
    """
    table = json.dumps([dict(zip(("filter_order", "step", "before", "bit"), x, strict=True)) for x in orders()])
    steps = F.from_json(F.lit(table), "array<struct<filter_order: string, step: int, before: int, bit: int>>")
    rows = masks(docs, labels, id_col, text_col, part_col).select("*", F.inline(steps))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~gone
    total = lambda when, what, name: F.sum(F.when(when, what).otherwise(0)).cast("long").alias(name)
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, F.col("n"), "kept"),
        total(here, F.col("n"), "removed"),
        total(fails & gone, F.col("n"), "redundant"),
        total(F.col("mask") == F.col("bit"), F.col("n"), "unique_fails"),
        total(here, F.col("good"), "good_lost"),
        total(here, F.col("toxic"), "toxic_lost"),
        total(fails, F.expr("n * (120 div greatest(bit_count(mask), 1))"), "shapley"),
    )


#: The audit of ``documents`` in DuckDB.
AUDIT_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failing AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM words
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS f, substr(filter_order, 1, s.step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), counted AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), tried AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS failed,
    earlier <> '' AND translate(fails, earlier, '') <> fails AS gone
  FROM counted, steps
), taken AS (
  SELECT part, f, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS shapley FROM tried GROUP BY part, f
)
SELECT part, filter_order, CAST(step AS INT) AS step,
  CAST(sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN failed AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN failed AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(any_value(shapley) AS BIGINT) AS shapley
FROM tried JOIN taken USING (part, f) GROUP BY part, filter_order, step
"""
