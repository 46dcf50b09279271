"""Cheap necessary conditions of an expression, derived from its parse tree.

Most rules match few texts. Before its expression runs over a text, a rule asks for what every match
must have: one of some literals, a number of digits, a mark such as @. One automaton over the literals
of all registered expressions passes each text once, whatever their number, so an expression that
cannot match costs a look at one element. The conditions never change a result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import found

_MARKS = "@:/=-$£€"
#: Marks that are rare enough to be literals by themselves.
_SIGNS = frozenset("$£€")
#: Sets of literals grow to so many members, classes to so many characters; shorter literals tell too little, but for signs.
_MOST, _MOST_CHARS, _LEAST = 64, 6, 2
#: Characters that a caseless expression takes for others and that lower() leaves apart: long s, dotless and dotted i, the Kelvin sign. Underscores may be blanks.
_FOLDED = {0x017F: "s", 0x0131: "i", 0x0130: "i", 0x212A: "k", 0x5F: " "}
#: The conditions of registered expressions: sets of literals by their place in the column of ``facts``.
_CONDITIONS: dict[tuple[str, ...], int] = {}


def _tree(pattern: str):
    """The parse tree; empty, so without conditions, for what the parser does not know."""
    plain = pattern.replace(r"\p{L}", "[a-z]")
    # inside a class the placeholder's brackets must go
    plain = re.sub(r"\[((?:[^\]\\]|\\.)*?)\[a-z\]", r"[\1a-z", plain)
    try:
        return parser.parse(plain)
    except re.error:
        return []


def fold(text: str) -> str:
    """Lower case, a character for each, so that what a caseless expression takes for a letter is that letter."""
    # replaced one by one: translate() looks up every character
    for c, plain in _FOLDED.items():
        text = text.replace(chr(c), plain)
    return text.lower()


@lru_cache(maxsize=1)
def _alone() -> frozenset[str]:
    """Characters that ``fold`` gives for everything that a caseless expression takes for them."""

    def single(c: str, other: str) -> str:
        return other if len(other) == 1 else c

    alike: dict[str, set[str]] = defaultdict(set)
    for i in range(0xD800):
        c = chr(i)
        upper = single(c, c.upper())
        alike[single(upper, upper.lower())].add(fold(c))
    # a sigma is folded by its place in the word
    return frozenset(next(iter(v)) for v in alike.values() if len(v) == 1) - set("\u03c3\u03c2")


def _exact(nodes) -> set[str] | None:
    """All strings that the nodes match, folded; None where they are too many or unknown."""
    out = {""}
    for kind, value in nodes:
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):  # these take no characters
            continue
        step: set[str] | None = None
        if kind is op.LITERAL:
            step = {fold(chr(value))}
        elif kind is op.IN and all(k is op.LITERAL or (k is op.RANGE and v[1] - v[0] < _MOST_CHARS) for k, v in value):
            step = {fold(chr(c)) for k, v in value for c in (range(v[0], v[1] + 1) if k is op.RANGE else [v])}
            step = step if len(step) <= _MOST_CHARS else None
        elif kind is op.SUBPATTERN:
            step = _exact(value[3])
        elif kind is op.BRANCH:
            parts = [_exact(b) for b in value[1]]
            step = None if any(p is None for p in parts) else set().union(*parts)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] == 1:
            step = _exact(value[2])
            step = step if step is None or value[0] else step | {""}
        if step is None or len(out) * len(step) > _MOST or not all(c in _alone() for x in step for c in x):
            return None
        out = {a + b for a in out for b in step}
    return out


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer, of equals the smaller."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _required(nodes) -> set[str] | None:
    """Folded literals, one of which is in every match; None where none is known."""
    best: set[str] | None = None
    run = {""}
    for node in nodes:
        kind, value = node
        step = _exact([node])
        if step is not None and len(run) * len(step) <= _MOST:
            run = {a + b for a in run for b in step}
            continue
        best, run = _better(best, run), step or {""}
        if kind is op.SUBPATTERN:
            best = _better(best, _required(value[3]))
        elif kind is op.BRANCH:
            parts = [_required(b) for b in value[1]]
            if all(parts):
                best = _better(best, set().union(*parts))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0]:
            best = _better(best, _required(value[2]))
    return _better(best, run)


@lru_cache(maxsize=None)
def literals(pattern: str) -> tuple[str, ...] | None:
    """Literals, one of which every match holds once both are folded; None where they would be too short."""
    best = _required(_tree(pattern))
    return tuple(sorted(best)) if best and all(len(w) >= _LEAST or w in _SIGNS for w in best) else None


def register(patterns: Iterable[str]) -> None:
    """Makes ``facts`` look for the literals of these expressions; others are guarded by digits and marks only."""
    for p in patterns:
        words = literals(p)
        if words:
            _CONDITIONS.setdefault(words, len(_CONDITIONS))


@lru_cache(maxsize=4)
def _automaton(conditions: tuple[tuple[str, ...], ...]):
    """The automaton of all literals; the value of each is the conditions that it meets."""
    of: dict[str, list[int]] = defaultdict(list)
    for k, words in enumerate(conditions):
        for w in words:
            of[w].append(k)
    out = ahocorasick.Automaton()
    for w, ks in of.items():
        out.add_word(w, tuple(ks))
    out.make_automaton()
    return out


def conditions_of(patterns: Iterable[str]) -> tuple[tuple[str, ...], ...]:
    """The conditions of these expressions only, for ``facts`` and ``may_match``."""
    known = {literals(p): None for p in patterns}
    return tuple(w for w in known if w)


def _held(text: Column, conditions: tuple[tuple[str, ...], ...]) -> Column:
    """Which conditions a text meets, an array of booleans; null for null. Without conditions no text goes to Python."""
    if not conditions:
        return F.array().cast("array<boolean>")

    @F.arrow_udf("array<boolean>")
    def held(texts: pa.Array) -> pa.Array:
        automaton = _automaton(conditions)
        met = np.zeros((len(texts), len(conditions)), bool)
        for row, t in zip(met, texts, strict=True):
            t = t.as_py()
            if t:
                ks = {k for _, k in automaton.iter(fold(t))}
                row[[x for k in ks for x in k]] = True
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(conditions))
        return pa.ListArray.from_arrays(offsets, pa.array(met.reshape(-1)), mask=texts.is_null())

    return held(text)


def least_digits(pattern: str) -> int:
    def count(nodes) -> int:
        n = 0
        for kind, value in nodes:
            if kind is op.LITERAL:
                n += chr(value).isdigit()
            elif kind is op.IN:
                n += all((k is op.CATEGORY and v is op.CATEGORY_DIGIT) or (k is op.LITERAL and chr(v).isdigit()) or (k is op.RANGE and chr(v[0]).isdigit() and chr(v[1]).isdigit()) for k, v in value)
            elif kind is op.SUBPATTERN:
                n += count(value[3])
            elif kind is op.BRANCH:
                n += min(count(b) for b in value[1])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                n += value[0] * count(value[2])
        return n

    return count(_tree(pattern))


def marks(pattern: str) -> set[str]:
    """Marks that every match holds."""

    def needed(nodes) -> set[str]:
        out: set[str] = set()
        for kind, value in nodes:
            if kind is op.LITERAL and chr(value) in _MARKS:
                out.add(chr(value))
            elif kind is op.SUBPATTERN:
                out |= needed(value[3])
            elif kind is op.BRANCH:
                out |= set.intersection(*(needed(b) for b in value[1]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0]:
                out |= needed(value[2])
        return out

    return needed(_tree(pattern))


def facts(text: Column, among: tuple[tuple[str, ...], ...] | None = None) -> dict[str, Column]:
    """Facts of a text, as columns by name; ``among`` are the conditions to look for, all registered ones by default."""
    return {"__held": _held(text, tuple(_CONDITIONS) if among is None else among), "__digits": F.length(F.regexp_replace(text, "[^0-9]+", ""))}


def may_match(text: Column, pattern: str, flags: str = "", among: tuple[tuple[str, ...], ...] | None = None) -> Column:
    """False only where the expression cannot match; reads the columns of ``facts`` with the same ``among``."""
    tests = []
    words = literals(pattern)
    place = _CONDITIONS.get(words) if among is None else among.index(words) if words in among else None
    if place is not None:
        # what was registered after the facts were taken is not among them
        tests.append(F.coalesce(F.get(F.col("__held"), F.lit(place)), F.lit(True)))
    digits = least_digits(pattern)
    if digits > 1:
        tests.append(F.col("__digits") >= digits)
    tests += [F.contains(text, F.lit(c)) for c in sorted(marks(pattern))]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def holds(text: Column, pattern: str, flags: str = "", guarded: bool = True) -> Column:
    """Whether the expression occurs; guarded, after the cheap conditions over the columns of ``facts``."""
    return (may_match(text, pattern, flags) & found(text, pattern, flags)) if guarded else found(text, pattern, flags)
