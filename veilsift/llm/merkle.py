"""Document fingerprints: a Merkle tree over chunks, paragraphs and sections.

A text is cut at blank lines into sections, those at line feeds into paragraphs, and a paragraph's
words into chunks that end where a word's hash says so, so an edit moves no boundary but its own.
A chunk's leaf is a hash of its words; paragraph, section and root nodes hash their children in order.
Leaves hash the words without white space; the root also hashes the whole text, so roots are equal
for equal texts only.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A word ends a chunk when its hash is 0 modulo this.
CHUNK = 4
#: Distinct leaves that a fingerprint carries at most; beyond, those with the most trailing zero bits stay.
LEAVES = 512
_LEAF_HEX = 10
#: Hex digits of the section and paragraph nodes that a fingerprint carries.
_NODE_HEX = 8
_LEAF = re.compile(rf"([0-9a-f]{{{_LEAF_HEX}}})(?:\*(\d+);)?")


class Tree:
    """Sections of paragraphs of (leaf hash, first word's place, last word's end), and the nodes' hashes."""

    def __init__(self, text: str):
        self.sections: list[tuple[str, list[tuple[str, list[tuple[int, int, int]]]]]] = []
        nodes = []
        at = 0
        for section in text.split("\n\n"):
            paragraphs, hashes, spot = [], [], at
            for paragraph in section.split("\n"):
                leaves = chunks(paragraph, spot)
                node = hashlib.sha256(b"".join(h.to_bytes(8, "little") for h, _, _ in leaves)).hexdigest()
                paragraphs.append((node, leaves))
                hashes.append(node)
                spot += len(paragraph) + 1
            node = hashlib.sha256("".join(hashes).encode()).hexdigest()
            self.sections.append((node, paragraphs))
            nodes.append(node)
            at += len(section) + 2
        whole = text.encode("utf-8", "surrogatepass")
        self.root = hashlib.sha256("".join(nodes).encode() + hashlib.sha256(whole).digest()).hexdigest()

    def leaves(self) -> list[int]:
        return [h for _, paragraphs in self.sections for _, leaves in paragraphs for h, _, _ in leaves]


def chunks(paragraph: str, at: int = 0) -> list[tuple[int, int, int]]:
    """(leaf hash, start, end) of each chunk of words; ``at`` is the paragraph's place in the text."""
    out, words, first, spot = [], [], 0, 0
    for w in paragraph.split(" "):
        if w:
            if not words:
                first = spot
            words.append(w)
            if _hash(w) % CHUNK == 0 or len(words) == 4 * CHUNK:
                out.append((_hash(" ".join(words)), at + first, at + spot + len(w)))
                words = []
        spot += len(w) + 1
    if words:
        out.append((_hash(" ".join(words)), at + first, at + len(paragraph)))
    return out


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))


def edits(old: str, new: str) -> list[tuple[str, int, int]]:
    """Where two texts differ: ("removed", start, end) spans of old and ("added", start, end) spans of new.

    Walks down only branches whose hashes differ; equal sections and paragraphs are matched by their
    nodes, the rest by their leaves. Equal roots give no spans.
    """
    a, b = Tree(old), Tree(new)
    if a.root == b.root:
        return []
    out: list[tuple[str, int, int]] = []
    for name, own, other in (("removed", a, b), ("added", b, a)):
        sections = {s for s, _ in other.sections}
        paragraphs = {p for _, ps in other.sections for p, _ in ps}
        leaves = set(other.leaves())
        for s, ps in own.sections:
            if s in sections:
                continue
            for p, ls in ps:
                if p not in paragraphs:
                    out += [(name, x, y) for h, x, y in ls if h not in leaves]
    return out


def _summary(text: str) -> tuple[str, Counter]:
    """The fingerprint of a text, and all its leaves with their counts."""
    tree = Tree(text)
    leaves = Counter(tree.leaves())
    mask = 2 ** (4 * _LEAF_HEX) - 1
    kept: Counter = Counter()
    for h, n in leaves.items():
        kept[h & mask] += n
    depth = 0
    while len(kept) > LEAVES and depth < 30:
        finer = {h: n for h, n in kept.items() if h % 2 ** (depth + 1) == 0}
        if not finer:
            break
        depth, kept = depth + 1, finer
    spelled = "".join(f"{h:0{_LEAF_HEX}x}" + (f"*{n};" if n > 1 else "") for h, n in sorted(kept.items()))
    nodes = "/".join(",".join(node[:_NODE_HEX] for node in (section, *(p for p, _ in paragraphs))) for section, paragraphs in tree.sections)
    return f"{tree.root[:32]}.{depth}.{sum(leaves.values())}.{spelled}.{nodes}", leaves


def fingerprint(text: str) -> str:
    """Root (32 hex digits), sampling depth, leaf count, the sorted distinct leaves that serve likeness, and the tree.

    A leaf that occurs n > 1 times is followed by ``*n;``. The tree is every section's node with its
    paragraphs' nodes: ``section,paragraph,paragraph/section,...``.
    """
    return _summary(text)[0]


def differing(a: str, b: str) -> list[tuple[str, int, int]]:
    """The paragraphs in which two fingerprints differ: ("a" or "b", section's number, paragraph's number).

    Equal roots give none. Only sections whose nodes the other tree lacks are walked; there, a paragraph
    differs when the other tree lacks its node. Texts that differ in white space alone have equal nodes.
    """
    if a == b:
        return []
    trees = [[section.split(",") for section in f.rsplit(".", 1)[1].split("/")] for f in (a, b)]
    out = []
    for side, own, other in (("a", *trees), ("b", *trees[::-1])):
        sections, paragraphs = {s[0] for s in other}, {p for s in other for p in s[1:]}
        out += [(side, i, j) for i, s in enumerate(own) if s[0] not in sections for j, p in enumerate(s[1:]) if p not in paragraphs]
    return out


def _shared(a: dict, b: dict) -> float:
    both = sum(min(n, b.get(h, 0)) for h, n in a.items())
    most = max(sum(a.values()), sum(b.values()))
    return min(both / most, 0.9999) if most else 0.0


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common, of the larger one's: 1 for equal texts, else below 1.

    Exact up to LEAVES distinct leaves in each; beyond, an estimate from the leaves that both keep.
    """
    if a == b:
        return 1.0
    (_, da, _, la, _), (_, db, _, lb, _) = a.split("."), b.split(".")
    depth = max(int(da), int(db))
    bags = [{h: int(n or 1) for h, n in _LEAF.findall(leaves) if not depth or int(h, 16) % 2**depth == 0} for leaves in (la, lb)]
    return _shared(*bags)


def _likeness_of(a: tuple[str, Counter], b: tuple[str, Counter]) -> float:
    """The likeness of two summaries over all their leaves."""
    return 1.0 if a[0] == b[0] else _shared(a[1], b[1])


def in_order(docs: DataFrame, id_col: str, columns: list[str], bins: int) -> DataFrame:
    """Rows dealt out by ranges of doc_id, each range one partition that also holds its successor.

    Adds ``__own``: false for the copy of the next range's first row. The ranges' ends come from a
    sample of ids; only one id a range reaches the driver or is broadcast.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("__id"))
    n = ids.count()
    cuts = ids.dropna().approxQuantile("__id", [i / bins for i in range(1, bins)], 0.25 / bins) if n > bins else []
    cuts = sorted({int(c) for c in cuts})
    bin_of = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("__id"))), F.lit(0)) if cuts else F.lit(0)
    placed = docs.select(F.col(id_col).cast("long").alias("__id"), *[F.col(c) for c in columns]).withColumn("__bin", bin_of.cast("int"))
    firsts = ids.withColumn("__bin", bin_of.cast("int")).dropna().groupBy("__bin").agg(F.min("__id").alias("__first")).collect()
    starts = sorted((r["__first"], r["__bin"]) for r in firsts)  # at most `bins` rows
    before = [(first, prev) for (first, _), (_, prev) in zip(starts[1:], starts, strict=False)]
    table = F.broadcast(spark.createDataFrame(before, "__first long, __prev int"))
    copies = placed.join(table, placed["__id"] == table["__first"]).select("__id", *columns, F.col("__prev").alias("__bin"), F.lit(False).alias("__own"))
    rows = placed.withColumn("__own", F.lit(True)).unionByName(copies)
    return rows.repartitionById(len(cuts) + 1, F.col("__bin"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text, in ascending doc_id order.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of the
    next document (after the last: the first). One row a document: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. The likenesses compare all leaves of the texts,
    also of those whose fingerprints carry a part of them.

    A null text is empty. Rows with one doc_id follow one another in text order. Null doc_ids come
    first. A single document is its own successor. An empty table gives no rows; other columns are
    ignored. Texts are shuffled once by ranges of doc_id.
    """
    tasks = bins or common.partitions(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    # the very first document follows the very last one
    head = plain.orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1).collect()
    first = head[0]["text"] if head else ""
    ordered = in_order(plain, "doc_id", ["text"], tasks)
    first_held = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: tuple[int | None, str, tuple[str, Counter]] | None = None
        copied = False
        out: list[tuple] = []

        def close(following: str, next_: tuple[str, Counter]) -> None:
            doc_id, text, own = held
            quarter = len(text) // 4
            edited = text[: len(text) - quarter] + following[:quarter]
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            other = _summary(edited)
            out.append((doc_id, len(text), sha, own[0], other[0], _likeness_of(own, other), _likeness_of(own, next_)))

        for batch in common.slices(batches):
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if copied:
                    continue  # rows that repeat the copy's doc_id
                summary = _summary(text)
                if held is not None:
                    close(text, summary)
                held, copied = (doc_id, text, summary), not own
            if out:
                yield _batch(out, names)
                out = []
        if held is not None and not copied:
            close(first_held.value, _summary(first_held.value))
            yield _batch(out, names)

    laid = ordered.sortWithinPartitions("__id", "text").select("__id", "text", "__own")
    return laid.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
