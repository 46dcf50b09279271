"""Byte-level byte-pair encoding and decoding in linear time.

A text is cut by the vocabulary's pattern; each piece is encoded alone. The bytes of a piece become
characters of Latin-1, and one pass of an Aho-Corasick automaton of all tokens gives the longest token
at every place. Encoding then goes from left to right: the longest token that is compatible with the
token before it is taken, a shorter prefix where it is not, and where none is, the token before is
taken back. Two adjacent tokens are compatible when merging their joined bytes by ranks gives exactly
these two; pairs are remembered.

Why this reproduces the merges: merges inside the bytes of two adjacent tokens of the result never
depend on bytes outside, so these bytes alone give the same two tokens. Conversely, where all adjacent
tokens are compatible, the first merge across a boundary would also happen in that pair alone, which it
does not. So each prefix has one encoding, a place where the search failed once can never be a boundary
again, and every place is left at most once.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces of more bytes are not remembered.
LONG_PIECE = 64


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: one line a token, its bytes in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Byte-pair merges spelled plainly: the adjacent pair of the lowest rank, leftmost first, until none is left."""
    none, get = 1 << 60, ranks.get
    parts = [data[i : i + 1] for i in range(len(data))]
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        rank = min(pairs)
        if rank == none:
            break
        i = pairs.index(rank)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return parts


class BytePairs:
    """Encodes and decodes by a table of ranks; ``room`` bounds remembered pieces and pairs.

    Remembered pieces have two generations: a full young one becomes the old one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = 250_000):
        self.ranks, self.room = ranks, room
        places = max(ranks.values(), default=-1) + 1
        self.token = [b""] * places
        self.size = [0] * places
        #: the longest token that is a proper prefix of a token; -1 where none is
        self.shorter = [-1] * places
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in ranks.items():
            self.token[r], self.size[r] = t, len(t)
            self.shorter[r] = next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1)
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern).findall
        # the same pattern for texts of ASCII characters only, where letters, digits and white space are these
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii_pieces = re.compile(plain, re.ASCII).findall if r"\p" not in plain else self.pieces
        self.pairs: dict[tuple[int, int], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens encode to these two; of one alone (left is -1), to itself. Remembers it."""
        if len(self.pairs) > 2 * self.room:
            self.pairs.clear()
        want = [self.token[right]] if left < 0 else [self.token[left], self.token[right]]
        known = self.pairs[left, right] = merged(b"".join(want), self.ranks) == want
        return known

    def encode_piece(self, data: bytes) -> array:
        """Ids of one piece; ValueError where a byte has no token."""
        whole = self.ranks.get(data)
        if whole is not None or not data:
            return array("i", [whole] if data else [])
        n, size, shorter, pairs = len(data), self.size, self.shorter, self.pairs
        longest = [-1] * n if n < 4096 else array("i", [-1]) * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # a later end at the same place is a longer token
        out: list[int] | array = [] if n < 4096 else array("i")
        dead = bytearray(n + 1)
        at, left, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not dead[end]:
                    fits = pairs.get((left, token))
                    if self.compatible(left, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, left = end, token
                if at < n:
                    token = longest[at]
            elif out:
                dead[at] = 1
                token = out.pop()  # its own end is dead now, so a shorter one follows
                at -= size[token]
                left = out[-1] if out else -1
            else:
                raise ValueError("the ranks have no token for a byte of the text")
        return array("i", out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers."""
        pieces = self.ascii_pieces(text) if text.isascii() else self.pieces(text)
        try:
            return b"".join(map(self.young.__getitem__, pieces))
        except KeyError:
            pass
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        long: dict[str, bytes] = {}
        for piece in set(pieces).difference(self.young):
            found = self.old.get(piece)
            if found is None:
                found = self.encode_piece(piece.encode()).tobytes()
            (self.young if len(piece) <= LONG_PIECE else long)[piece] = found
        return b"".join([self.young[p] if len(p) <= LONG_PIECE else long[p] for p in pieces])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_known: dict[tuple[int, str], BytePairs] = {}


def _byte_pairs(content: bytes, pattern: str) -> BytePairs:
    """The worker's tables, kept between tasks in a reused Python worker."""
    key = (hash(content), pattern)
    if key not in _known:
        _known.clear()
        _known[key] = BytePairs(read_ranks(content), pattern)
    return _known[key]


def default_ranks() -> tuple[str, str]:
    """The file of ranks and the pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _sent(docs: DataFrame, ranks_path: str | None, pattern: str | None):
    path, known = default_ranks() if ranks_path is None or pattern is None else ("", "")
    with open(ranks_path or path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read()), pattern or known


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: doc_id, ids (array of int), as the ranks' own library encodes ordinary text.

    The file of ranks (1 to 2 MB) is read on the driver and broadcast. A null or empty text has no
    ids; null and repeated doc_ids are rows like others; an empty table gives no rows; other columns
    are not read. Texts of any length are encoded whole, in time linear in their bytes.
    """
    content, pattern = _sent(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_pairs(content.value, pattern)
        for batch in common.slices(batches, 64):
            ids = [table.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids])
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    plain = docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows of doc_id and ids with the bytes they stand for: doc_id, ids, decoded (binary); null ids decode to nothing."""
    content, pattern = _sent(encoded, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_pairs(content.value, pattern)
        for batch in common.slices(batches, 64):
            ids = batch.column(1)
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            out = [table.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
