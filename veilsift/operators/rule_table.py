"""Scanning texts with a table of rules of any size.

Rules are data: a keyword rule lists words, a regex rule holds an ECMAScript expression. An Aho-Corasick
automaton passes each text once, whatever the number of rules. It holds all keywords, whose matches it
tells in full, and for each expression literals of which every match must hold one, taken from its parse
tree; only expressions with such a literal in the text then run, in the JVM, and where what may stand around the
literal is known, over the pieces around its places only. The plan has the same size for ten rules and
for a million, and a text pays for its length and for what it holds, not for the rules.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as op
from types import SimpleNamespace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import code_points, java_regex
from ..functions.prefilter import _tree

#: The columns of a rules table; severity and category are handed on.
RULES = "id string, type string, severity string, category string, regex string, keywords array<string>, case_sensitive boolean, whole_word boolean, enabled boolean"

#: Rules are broadcast in blocks of about so many bytes of words and literals; each block is one pass over the texts.
BLOCK_BYTES = 8 << 20
#: Tasks hand rules on in parts of about so many bytes of them.
PART_BYTES = 1 << 18
#: Pieces of a text for one expression: longer ones are not sent, the expression reads the whole text then.
PIECES = 4000
#: Stands between pieces, where no expression that runs over them goes on.
_GAP = "\x01"

#: Characters beyond ASCII that a caseless expression takes for ASCII letters: long s, dotless and dotted i, the Kelvin sign.
_FOLDED = {0x017F: "s", 0x0131: "i", 0x0130: "i", 0x212A: "k"}

#: What an expression takes for white space.
_SPACES = frozenset(" \t\n\x0b\f\r\u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}

_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def fold(text: str) -> str:
    """Lower case, a character for each, so that whatever a caseless expression takes for an ASCII letter is that letter."""
    if not text.isascii():
        # replaced one by one: translate() looks up every character
        for c, plain in _FOLDED.items():
            text = text.replace(chr(c), plain)
    return text.lower()


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer, of equals the smaller."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _required(nodes) -> set[str] | None:
    """Lower-case ASCII literals, one of which is in every match; None where none is known."""
    best: set[str] | None = None
    run = ""

    def close() -> None:
        nonlocal best, run
        best = _better(best, {run} if run else None)
        run = ""

    for kind, value in nodes:
        if kind is op.LITERAL and value < 0x80:
            run += chr(value).lower()
            continue
        if kind is op.SUBPATTERN and all(k is op.LITERAL and v < 0x80 for k, v in value[3]):
            run += "".join(chr(v).lower() for _, v in value[3])
            continue
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):  # these take no characters
            continue
        close()
        if kind is op.SUBPATTERN:
            best = _better(best, _required(value[3]))
        elif kind is op.BRANCH:
            parts = [_required(b) for b in value[1]]
            if all(parts):
                best = _better(best, set().union(*parts))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0]:
            best = _better(best, _required(value[2]))
        elif kind is op.IN and all(k is op.LITERAL and v < 0x80 for k, v in value):
            best = _better(best, {chr(v).lower() for _, v in value})
    close()
    return best


@lru_cache(maxsize=4)
def _nodes(pattern: str) -> list:
    return list(_tree(pattern))


def regex_literals(pattern: str) -> set[str] | None:
    return _required(_nodes(pattern))


def _run(pattern: str, literal: str) -> int | None:
    """Where a plain sequence of nodes holds the literal, if it does once."""
    nodes, n = _nodes(pattern), len(literal)
    runs = [i for i in range(len(nodes) - n + 1) if all(k is op.LITERAL and v < 0x80 and chr(v).lower() == c for (k, v), c in zip(nodes[i : i + n], literal, strict=True))]
    return runs[0] if len(runs) == 1 else None


@lru_cache(maxsize=1000)
def _same(value):
    """The first of equal values, so that parts spell it once."""
    return value


_CLASSES = {
    op.CATEGORY_SPACE: _SPACES,
    op.CATEGORY_DIGIT: frozenset("0123456789"),
    op.CATEGORY_WORD: frozenset("abcdefghijklmnopqrstuvwxyz0123456789_"),
}


def _taken(nodes) -> frozenset[str] | None:
    """The folded characters that nodes may take; None where they are too many, or assertions look farther than a character."""
    out: frozenset[str] = frozenset()
    for kind, value in nodes:
        more: frozenset[str] | None = None
        if kind is op.LITERAL:
            more = frozenset(fold(chr(value))) if value < 0x80 else None
        elif kind is op.IN:
            sets = [frozenset(fold(chr(v))) if k is op.LITERAL and v < 0x80 else frozenset(fold(chr(c)) for c in range(v[0], v[1] + 1)) if k is op.RANGE and v[1] < 0x80 else _CLASSES.get(v) if k is op.CATEGORY else None for k, v in value]
            more = None if any(x is None for x in sets) else frozenset().union(*sets)
        elif kind is op.SUBPATTERN:
            more = _taken(value[3])
        elif kind is op.BRANCH:
            sets = [_taken(b) for b in value[1]]
            more = None if any(x is None for x in sets) else frozenset().union(*sets)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            more = _taken(value[2])
        elif kind is op.AT and value in (op.AT_BOUNDARY, op.AT_NON_BOUNDARY):
            more = frozenset()
        if more is None or _GAP in more:
            return None
        out |= more
    return out


def reach(pattern: str, literal: str) -> tuple[frozenset[str], frozenset[str]] | None:
    """The folded characters that a match may take before and after a literal, where these are known and few.

    All matches then lie in the stretches of such characters around the literal's places: an expression that
    sees these, and a character more on either side, finds what it finds in the whole text.
    """
    at = _run(pattern, literal)
    # what the parser does not know stands there as something else
    if at is None or _GAP in literal or "\\p" in pattern or "\\P" in pattern or "(?i" in pattern:
        return None
    nodes = _nodes(pattern)
    before, after = _taken(nodes[:at]), _taken(nodes[at + len(literal) :])
    return None if before is None or after is None else _same((before, after))


def _character(node) -> frozenset[str] | None:
    """The folded characters one of which stands where a node begins or, of one character, ends; None where others may."""
    kind, value = node
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        return _character(value[2][0]) if value[0] and len(value[2]) == 1 else None
    if kind is op.LITERAL:
        return frozenset(fold(chr(value))) if value < 0x80 else None
    if kind is op.IN and all((k is op.LITERAL and v < 0x80) or (k is op.CATEGORY and v is op.CATEGORY_SPACE) for k, v in value):
        return frozenset().union(*(_SPACES if k is op.CATEGORY else {fold(chr(v))} for k, v in value))
    return None


def neighbours(pattern: str, literal: str) -> tuple[frozenset[str] | None, frozenset[str] | None, bool]:
    """What stands before and after a literal in each match, and whether no ASCII word character stands before it.

    Known where the expression is a plain sequence that holds the literal once, as a run of characters of its
    own; otherwise nothing is (None, None, False). Conditions are necessary ones: the expression still decides.
    """
    i, nodes, n = _run(pattern, literal), _nodes(pattern), len(literal)
    if i is None or not literal[0].isalnum():
        return None, None, False
    before = nodes[i - 1] if i else None
    after = nodes[i + n] if i + n < len(nodes) else None
    edge = before is not None and before[0] is op.AT and before[1] is op.AT_BOUNDARY
    return (_character(before) if before is not None else None), (_character(after) if after is not None else None), edge


class Matcher:
    """Keywords and literals of a block of rules over one automaton.

    ``keywords`` has (rule, word, whole word, case-sensitive), ``literals`` (rule, literal, what ``neighbours``
    tells or None, what ``reach`` tells); the rules of ``always`` are candidates of every text.
    """

    def __init__(self, keywords: list[tuple[int, str, bool, bool]], literals: list[tuple[int, str, tuple | None, tuple | None]], always: list[int]):
        held: dict[str, tuple] = {}
        for rule, word, whole, cased in keywords:
            folded = fold(word)
            words, rules = held.get(folded, ((), ()))
            held[folded] = (*words, (rule, word if cased else None, whole)), rules
        for rule, literal, near, around in literals:
            words, rules = held.get(literal, ((), ()))
            held[literal] = words, (*rules, (rule, near, around))
        self.always = sorted(always)
        self.automaton = ahocorasick.Automaton()
        self.empty = not held
        while held:
            word, (words, rules) = held.popitem()
            self.automaton.add_word(word, (len(word), words, rules))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int | None, int | None, str | None, str | None, list | None]]:
        """(rule, n, place, first match, None, None) of keyword rules that match; (rule, None, None, None, pieces, places) of candidates. By rule.

        Pieces are what the expression has to see, with their places (there, in the text); None: the whole text.
        """
        out: list[tuple] = [(r, None, None, None, None, None) for r in self.always] if text else []
        if self.empty or not text:
            return out
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        likely: set[int] = set()
        near_by: dict[int, tuple[tuple, list[tuple[int, int]]]] = {}
        folded = fold(text)
        for last, entry in self.automaton.iter(folded):
            size, words, rules = entry
            start = last + 1 - size
            for rule, near, around in rules:
                if around is not None:
                    # also places that are no match's: what is near them may be taken for a text's end otherwise
                    near_by.setdefault(rule, (around, []))[1].append((start, last + 1))
                if rule not in likely and (near is None or _fits(folded, text, start, last + 1, near)):
                    likely.add(rule)
            for rule, cased, whole in words:
                if cased is not None and text[start : last + 1] != cased:
                    continue
                if whole and not (_edge(text, start) and _edge(text, last + 1)):
                    continue
                spans[rule].append((start, -last - 1))
        for rule, found in spans.items():
            # from left to right, of words that start together the longest; what overlaps the one before goes
            found.sort()
            n, free = 0, 0
            for start, end in found:
                if start >= free:
                    n, free = n + 1, -end
            out.append((rule, n, found[0][0], text[found[0][0] : -found[0][1]], None, None))
        for rule in likely.difference(self.always):
            pieces = _pieces(folded, text, *near_by[rule]) if rule in near_by else None
            out.append((rule, None, None, None, *(pieces or (None, None))))
        return sorted(out, key=lambda x: x[0])


def _pieces(folded: str, text: str, around: tuple[frozenset[str], frozenset[str]], places: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]] | None:
    """The stretches around the places (in order) of a literal, joined, and where each begins there and in the text; None if they are too long."""
    before, after = around
    size, cuts = len(text), []
    core = end = 0  # where the last literal's stretch and the last piece end
    for start, stop in places:
        left = start
        while left > end and folded[left - 1] in before:
            left -= 1
        # within the last stretch this one ends where that does
        right = core if cuts and stop <= core else stop
        while right < size and folded[right] in after:
            right += 1
        core = right
        left = max(left - 1, 0)
        if cuts and left <= end:
            cuts[-1][1] = end = max(end, min(right + 1, size))
        else:
            end = min(right + 1, size)
            cuts.append([left, end])
    if sum(b - a for a, b in cuts) > PIECES:
        return None
    at, out = 0, []
    for a, b in cuts:
        out.append((at, a))
        at += b - a + len(_GAP)
    return _GAP.join(text[a:b] for a, b in cuts), out


def _fits(folded: str, text: str, start: int, end: int, near: tuple) -> bool:
    """Whether a literal stands among what every match has beside it."""
    before, after, edge = near
    if edge and start and text[start - 1] in _WORD:
        return False
    if before is not None and (not start or folded[start - 1] not in before):
        return False
    return after is None or (end < len(folded) and folded[end] in after)


def _edge(text: str, at: int) -> bool:
    """Whether a word of ASCII word characters begins or ends at a place."""
    return ((at > 0 and text[at - 1] in _WORD) != (at < len(text) and text[at] in _WORD))


_matchers: dict[str, tuple[Matcher, pa.Table]] = {}

_FACTS = ["rule_id", "severity", "category", "java"]


def _matcher(name: str, parts: list[bytes]) -> tuple[Matcher, pa.Table]:
    """The worker's automaton and what its rules hand on, kept between tasks in a reused Python worker."""
    if name not in _matchers:
        _matchers.clear()
        tables, keywords, literals, always, base = [], [], [], [], 0
        for part in parts:
            block: _Block = pickle.loads(zlib.decompress(part))
            columns = list(zip(*block.rows, strict=True)) or [()] * (1 + len(_FACTS))
            tables.append(pa.table({c: pa.array(v, pa.string()) for c, v in zip(_FACTS, columns[1:], strict=True)}))
            keywords += [(base + r, *x) for r, *x in block.keywords]
            literals += [(base + r, *x) for r, *x in block.literals]
            always += [base + r for r in block.always]
            base += len(block.rows)
        _matchers[name] = Matcher(keywords, literals, always), pa.concat_tables(tables).combine_chunks()
    return _matchers[name]


HITS = "array<struct<rule_id: string, severity: string, category: string, java: string, n: int, place: int, matched: string, pieces: string, places: array<struct<at: int, base: int>>>>"


def hits(text: Column, parts: list[bytes]) -> Column:
    """What ``Matcher.find`` tells of a text, as an array, with the facts of each rule."""
    sent = SparkSession.active().sparkContext.broadcast((uuid.uuid4().hex, parts))

    @F.arrow_udf(HITS)
    def found(texts: pa.Array) -> pa.Array:
        matcher, table = _matcher(*sent.value)
        ends, rows = [0], []
        for t in texts:
            t = t.as_py()
            rows += matcher.find(t) if t else []
            ends.append(len(rows))
        rules, n, place, matched, pieces, places = zip(*rows, strict=True) if rows else ((),) * 6
        facts = table.take(pa.array(rules, pa.int64())).combine_chunks()
        cuts = [x for xs in places if xs for x in xs]
        pairs = pa.StructArray.from_arrays([pa.array([c[i] for c in cuts], pa.int32()) for i in (0, 1)], ["at", "base"])
        bounds = pa.array(np.cumsum([0] + [len(xs or ()) for xs in places]), pa.int32())
        columns = [pa.array(n, pa.int32()), pa.array(place, pa.int32()), pa.array(matched, pa.string()), pa.array(pieces, pa.string()), pa.ListArray.from_arrays(bounds, pairs)]
        known = [facts[c].combine_chunks() for c in _FACTS]
        known = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in known]
        flat = pa.StructArray.from_arrays([*known, *columns], [*_FACTS, "n", "place", "matched", "pieces", "places"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return found(text)


class _Block:
    """Rules of one broadcast, or a part of it: what they hand on, their keywords and literals for the automaton."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.keywords: list[tuple[int, str, bool, bool]] = []
        self.literals: list[tuple[int, str, tuple | None, tuple | None]] = []
        self.always: list[int] = []
        self.size = 0

    def add(self, rule) -> None:
        number, java = len(self.rows), None
        if rule.type == "keyword":
            words = {w for w in rule.keywords if w}
            self.keywords += [(number, w, bool(rule.whole_word), bool(rule.case_sensitive)) for w in sorted(words)]
            self.size += sum(map(len, words))
        else:
            java = java_regex(rule.regex, "" if rule.case_sensitive else "i")
            found = sorted(regex_literals(rule.regex) or ())
            near, around = (neighbours(rule.regex, found[0]), reach(rule.regex, found[0])) if len(found) == 1 else ((None, None, False), None)
            self.literals += [(number, x, _same(near) if any(near) else None, around) for x in found]
            if not found:
                self.always.append(number)
            self.size += sum(map(len, found))
        self.rows.append((number, rule.id, rule.severity, rule.category, java))


def _parts(limit: int):
    """Rules as parts of a block (its size, and the part pickled), for ``mapInArrow``: expressions are taken apart by tasks, not by the driver."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(block: _Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block.size], pa.int64()), pa.array([zlib.compress(pickle.dumps(block), 1)], pa.binary())], ["size", "part"])

        block = _Block()
        for batch in batches:
            for row in batch.to_pylist():
                if block.rows and block.size >= limit:
                    yield sent(block)
                    block = _Block()
                block.add(SimpleNamespace(**row))
        if block.rows:
            yield sent(block)

    return packed


def _usable(rules_df: DataFrame) -> DataFrame:
    """Enabled rules that have an expression or a word; rules of other types need other inputs than texts."""
    words = F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: F.coalesce(w, F.lit("")) != "")
    usable = ((F.col("type") == "keyword") & words) | ((F.col("type") == "regex") & (F.coalesce("regex", F.lit("")) != ""))
    return rules_df.where(F.coalesce("enabled", F.lit(True)) & usable)


def scan_with_rules(df: DataFrame, rules_df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each text and rule that matches: ``keep``, rule_id, severity, category, n, place, matched.

    n counts matches that do not overlap, place (code points from 0) and matched are of the first. A
    keyword rule matches any of its words, from left to right, the longest of those that start together;
    a whole word stands between ASCII word boundaries. Rules are caseless unless ``case_sensitive`` is
    true. Disabled rules, rules without words or expression and rules of other types give no rows; rules
    that share an id are rules of their own; matches of no characters do not count. Null and empty texts
    give no rows, and neither do empty tables.

    Rules are taken apart by tasks and pass the driver once, packed, in blocks of bounded bytes, each of which is
    broadcast and scanned for in a pass of its own; texts stay where they are and are never shuffled.
    """
    usable = _usable(rules_df).select("id", "type", "severity", "category", "regex", "keywords", "case_sensitive", "whole_word")
    blocks, size = [[]], 0
    for row in usable.mapInArrow(_parts(min(block_bytes, PART_BYTES)), "size long, part binary").collect():
        if blocks[-1] and size >= block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append(bytes(row.part))
        size += row.size
    out = None
    for b in blocks:
        found = _scan_block(df, b, text_col, keep)
        out = found if out is None else out.unionByName(found)
    return out


def _scan_block(df: DataFrame, parts: list[bytes], text_col: str, keep: tuple[str, ...]) -> DataFrame:
    if not parts:  # no rules: no text is read
        none = F.explode(F.array().cast(HITS)).alias("h")
        return df.select(*keep, none).select(*keep, "h.rule_id", "h.severity", "h.category", "h.n", "h.place", "h.matched")
    base = df.select(*keep, F.col(text_col).alias("__text"))
    may = base.withColumn("__hits", hits(F.col("__text"), parts))
    # the text goes along with candidates only, and not where their pieces do; an outer explode, since the optimizer
    # would put the hits of an inner one into a filter below it and have all texts searched twice
    whole = F.exists("__hits", lambda h: h["java"].isNotNull() & h["pieces"].isNull())
    rows = may.select(*keep, F.when(whole, F.col("__text")).alias("__text"), "__hits").select(*keep, "__text", F.explode_outer("__hits").alias("h")).where("h is not null")
    seen = F.when(F.col("h.java").isNotNull(), F.coalesce("h.pieces", "__text")).alias("__text")
    rows = rows.select(*keep, seen, "h.*")
    # one pass of an expression for all its matches, kept in a row of its own so that no column spells it again
    regex = F.col("java").isNotNull()
    every = F.filter(F.regexp_extract_all("__text", F.col("java"), F.lit(0)), lambda m: m != "")
    first = lambda e: F.when(F.size(e) > 0, F.regexp_instr("__text", F.col("java")))
    summed = F.transform(F.array(every), lambda e: F.struct(F.size(e).alias("n"), F.get(e, F.lit(0)).alias("matched"), first(e).alias("at")))
    known = F.array(F.struct("n", "matched", F.lit(None).cast("int").alias("at")))
    told = rows.withColumn("__m", F.explode(F.when(regex, summed).otherwise(known))).where("__m.n > 0")
    told = told.withColumn("__at", F.when(regex, code_points(F.col("__text"), F.col("__m.at"))).otherwise(F.col("place")).cast("int"))
    piece = F.element_at(F.filter("places", lambda p: p["at"] <= F.col("__at")), -1)
    place = F.when(F.size("places") > 0, F.col("__at") - piece["at"] + piece["base"]).otherwise(F.col("__at"))
    return told.select(*keep, "rule_id", "severity", "category", "__m.n", place.alias("place"), "__m.matched")
