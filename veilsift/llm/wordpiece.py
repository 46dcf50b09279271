"""Token counts by greedy longest match in linear time, over a trie with failure links."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_UNITS = re.compile(r"[^\W_]+|[^\w\s]|_")


class Automaton:
    """Counts the pieces of greedy longest match without building them.

    Vocabulary entries are of two kinds: those that start a word and those that continue one; each
    kind has a root of its own in one trie. A node's failure link leads to the node that stands for
    the rest of its string after the longest pieces on the way were taken off its front; ``popped``
    is how many those are. So a step either goes down the trie or pops a known number of pieces,
    and a word takes time linear in its length. A node without a link cannot be cut: the word is one
    unknown piece.
    """

    def __init__(self, starts: set[str], continues: set[str]):
        self.go: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        ends: dict[int, bool] = {}
        same = starts == continues
        if same:  # one trie serves both roots
            self.go[0] = self.go[1]
        for root, vocabulary in ((1, continues),) if same else ((0, starts), (1, continues)):
            for piece in sorted(vocabulary):
                at = root
                for c in piece:
                    nxt = self.go[at].get(c)
                    if nxt is None:
                        nxt = len(self.go)
                        self.go.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                        self.go[at][c] = nxt
                    at = nxt
                if piece:
                    ends[at] = True
        queue = deque([1] if same else [0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.go[u].items():
                if v in ends:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, pops = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.go[z]:
                        pops, z = pops + self.popped[z], self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.go[z][c], pops
                queue.append(v)

    def count(self, word: str) -> int:
        """Number of pieces; 1 for a word that cannot be cut, 0 for an empty one."""
        go, fail, popped = self.go, self.fail, self.popped
        at, n = 0, 0
        for c in word:
            while c not in go[at]:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = go[at][c]
        while at > 1:  # both roots stand for an empty rest
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


def greedy_count(word: str, starts: set[str], continues: set[str]) -> int:
    """The same number by trying the longest piece first at each place (the definition)."""
    at = n = 0
    while at < len(word):
        vocabulary = continues if at else starts
        to = next((k for k in range(len(word), at, -1) if word[at:k] in vocabulary), 0)
        if not to:
            return 1
        at, n = to, n + 1
    return n


def vocabulary(spec: str, end: str = "</w>", mark: str = "") -> tuple[set[str], set[str]]:
    """Starting and continuing pieces of a tokenizer file's vocabulary, as sets of texts.

    Entries that end a word carry ``end``: it becomes one end character, which every word ends with,
    so greedy match prefers a piece that ends the word there. With ``mark`` (such as ##), entries that
    carry it continue a word and the others start one; without, every entry does both. Byte-level
    entries that are no whole text stay out.
    """
    to_byte = {c: b for b, c in common._byte_alphabet().items()}
    starts, continues = set(), set()
    for piece in json.loads(spec)["model"]["vocab"]:
        tail = ""
        if end and piece.endswith(end):
            piece, tail = piece[: -len(end)], "\n"
        inner = bool(mark) and piece.startswith(mark)
        body = piece[len(mark) :] if inner else piece
        try:
            body = bytes(to_byte[c] for c in body).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if body:
            if not mark or not inner:
                starts.add(body + tail)
            if not mark or inner:
                continues.add(body + tail)
    return starts, continues


def token_counts(docs: DataFrame, tokenizer: str | None = None, end: str = "</w>", mark: str = "", room: int = 150_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_tokens (greedy word-piece length), n_unknown words.

    Texts are lowered and cut into runs of letters and digits, single marks and line bars; each word
    counts its pieces, one that cannot be cut counts 1 and is unknown. Null and empty texts count 0;
    null doc_ids stay null; repeated rows count each; an empty table gives no rows; other columns are
    ignored. A narrow pass: no row moves. Remembered words are bounded by ``room``.
    """
    spec = docs.sparkSession.sparkContext.broadcast(common.tokenizer_spec(tokenizer or common.default_tokenizer()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, continues = vocabulary(spec.value, end, mark)
        tail = "\n" if end else ""
        own = Counts(Automaton(starts, continues), tail, room)
        for batch in common.slices(batches):
            words, tokens, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                found = _UNITS.findall(text.lower())
                own.trim()
                sizes = list(map(own.__getitem__, found))
                words.append(len(found))
                lost = sizes.count(0)
                tokens.append(sum(sizes) + lost)
                unknown.append(lost)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "n_unknown": pa.array(unknown, pa.int64())})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


class Counts(dict):
    """Pieces of each word seen (0: unknown), counted by the automaton once."""

    def __init__(self, automaton: Automaton, tail: str, room: int):
        super().__init__()
        self.automaton, self.tail, self.room = automaton, tail, room

    def trim(self) -> None:
        if len(self) > self.room:
            self.clear()

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word + self.tail)
        known = n > 1 or self.whole(word + self.tail)
        self[word] = n if known else 0
        return self[word]

    def whole(self, word: str) -> bool:
        """Whether the word is one piece (count gives 1 for unknown words too)."""
        at = 0
        for c in word:
            at = self.automaton.go[at].get(c, -1)
            if at < 0:
                return False
        return self.automaton.fail[at] == 1 and self.automaton.popped[at] == 1
