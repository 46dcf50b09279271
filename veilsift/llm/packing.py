"""Packing of token pieces into sequences: first-fit decreasing with a tournament tree."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class TournamentTree:
    """Room left in each bin, with the maximum of each pair above it up to the root.

    ``place(n)`` walks from the root to the first (leftmost) bin with room for n, opening
    bins from left to right, in a number of steps that is the tree's height.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, n: int) -> int:
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < n:
                at += 1
        spot = at - self.leaves
        best[at] -= n
        while at > 1:
            at //= 2
            left, right = best[2 * at], best[2 * at + 1]
            top = left if left > right else right
            if best[at] == top:
                break
            best[at] = top
        return spot


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (each at most ``capacity``), taken in the given order after a stable sort by falling length."""
    order = np.argsort(-lengths, kind="stable")
    tree = TournamentTree(max(1, len(lengths)), capacity)
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    filled: dict[int, int] = {}
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        b = tree.place(n)
        bins[i], offsets[i] = b, filled.get(b, 0)
        filled[b] = offsets[i] + n
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's token ids: full ones of ``capacity`` ids, then the remainder."""
    spec = docs.sparkSession.sparkContext.broadcast(common.tokenizer_spec(tokenizer))
    end, step = struct.pack("<I", end_id), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = common.encoder(spec.value)
        for batch in common.slices(batches):
            rows = []
            for d, x in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist()), strict=True):
                x += end
                for i in range(0, len(x), step):
                    piece = x[i : i + step]
                    rows.append((d, i // 4, len(piece) // 4, zlib.crc32(piece), len(x) // 4))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long"), common.text_or_empty(text_col)).mapInArrow(cut, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, group_pieces: int = 16_384, seed: int = 7) -> DataFrame:
    """Give each piece a sequence_id and an offset in it; sequences hold at most ``capacity`` ids.

    Pieces go to random groups of about ``group_pieces`` by a hash of document and start, so a
    group's memory is bounded whatever the table's size, and each group is packed on its own by
    first-fit decreasing. A sequence_id is the group's number times 2**32 plus the bin's. Ties in
    length are broken by doc_id and start, so the result does not depend on the partitioning.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    # a document's row number among repeats is unknown, so the checksum helps to spread them
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(seed)), F.lit(groups)).cast("long")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", na_position="first")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), capacity)
        return part.assign(sequence_id=part["pack_group"].to_numpy() * 2**32 + bins, offset=offsets).drop(columns="pack_group")

    return pieces.withColumn("pack_group", group).groupBy("pack_group").applyInPandas(pack, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 2, group_pieces: int = 16_384, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` token ids.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or
    empty text gives one piece with the end id alone; a null doc_id stays null; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored. Texts never move: only
    piece lengths are shuffled.
    """
    pieces = common.stored(cut_documents(docs, tokenizer or common.default_tokenizer(), capacity, end_id, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity, group_pieces, seed)
