"""ECMAScript regular expressions as Java ones, and windows of text around a match."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII_WORD = "[A-Za-z0-9_]"
#: ECMAScript's \b knows ASCII words only; Java's also knows letters like ø.
_BOUNDARY = f"(?:(?<={_ASCII_WORD})(?!{_ASCII_WORD})|(?<!{_ASCII_WORD})(?={_ASCII_WORD}))"
#: What ECMAScript's \s has beyond Java's.
_MORE_SPACE = r"\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _alternatives(body: str) -> list[str]:
    """The top-level alternatives of an expression."""
    out, depth, inside, start, i = [], 0, False, 0, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                break
        elif c == "|" and not depth:
            out.append(body[start:i])
            start = i + 1
        i += 1
    return [*out, body[start:i]]


_ONE = re.compile(r"(?:[A-Za-z0-9_]|\\[dw]|\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_]|\\[dw])+\])")


def _starts_with_word(rest: str) -> bool:
    """Whether every match of what follows surely starts with an ASCII word character."""
    m = re.match(r"\((?:\?:)?", rest)
    if m:
        return all(_starts_with_word(a) for a in _alternatives(rest[m.end() :])) and not re.match(r"[?*]|\{0", _after_group(rest))
    m = _ONE.match(rest)
    return bool(m) and not re.match(r"[?*]|\{0", rest[m.end() :])


def _after_group(rest: str) -> str:
    depth, inside, i = 0, False, 0
    while i < len(rest):
        c = rest[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return rest[i + 1 :]
        i += 1
    return ""


def _ends_with_word(head: str) -> bool:
    """Whether every match of what comes before surely ends with an ASCII word character."""
    m = re.search(r"(?:\{[1-9]\d*(?:,\d*)?\}|\+\??)$", head)
    if m:
        head = head[: m.start()]
    if head.endswith(")") and not head.endswith("\\)"):
        for i in range(len(head) - 1, -1, -1):
            if head[i] == "(" and head[i - 1 : i] != "\\" and _after_group(head[i:]) == "" and head.endswith(")"):
                body = re.sub(r"^\((?:\?:)?", "", head[i:])
                if body.startswith("?") or len(_after_group(head[i:])):
                    return False
                return all(_ends_with_word(a) for a in _alternatives(body))
        return False
    m = re.search(rf"{_ONE.pattern}$", head)
    return bool(m) and not (len(m[0]) == 1 and head[: m.start()].endswith("\\"))


def java_regex(pattern: str, flags: str = "") -> str:
    """The Java expression that matches what the ECMAScript one does.

    Case folding is Unicode-aware, word boundaries and \\w are ASCII, white space includes the
    Unicode spaces, and an opening bracket inside a class is literal.
    """
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\b" and not inside:
                # next to a word character one look-around says it all
                if _starts_with_word(pattern[i + 2 :]):
                    out.append(f"(?<!{_ASCII_WORD})")
                elif _ends_with_word(pattern[:i]):
                    out.append(f"(?!{_ASCII_WORD})")
                else:
                    out.append(_BOUNDARY)
            elif pair == r"\B" and not inside:
                out.append(f"(?:(?<={_ASCII_WORD})(?={_ASCII_WORD})|(?<!{_ASCII_WORD})(?!{_ASCII_WORD}))")
            elif pair == r"\s":
                out.append(rf"\s{_MORE_SPACE}" if inside else rf"[\s{_MORE_SPACE}]")
            elif pair == r"\S" and not inside:
                out.append(rf"[^\s{_MORE_SPACE}]")
            elif pair == r"\/":
                out.append("/")
            else:
                out.append(pair)
            i += 2
            continue
        if c == "[" and inside:
            out.append(r"\[")
        elif c == "&" and inside and pattern[i : i + 2] == "&&":
            out.append(r"\&")
        else:
            out.append(c)
        inside = (inside or c == "[") and not (inside and c == "]")
        i += 1
    mode = ("iu" if "i" in flags else "") + ("m" if "m" in flags else "")
    return (f"(?{mode})" if mode else "") + "".join(out)


def found(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(java_regex(pattern, flags))


def first_match(text: Column, pattern: str, flags: str = "") -> Column:
    """The first match, or null."""
    m = F.regexp_extract(text, java_regex(pattern, flags), 0)
    return F.when(m != "", m)


def place_of(text: Column, pattern: Column) -> Column:
    """Place of a Java expression's first match in code points from 0, or null.

    regexp_instr counts UTF-16 units, so characters beyond the basic plane before the match are
    taken off again.
    """
    return code_points(text, F.regexp_instr(text, pattern))


def code_points(text: Column, at: Column) -> Column:
    """A place in code points from 0 of one in UTF-16 units from 1, or null for 0."""
    astral = r"[\x{10000}-\x{10FFFF}]"
    # as many characters as units, so that what stands before the place is cut there
    units = F.regexp_replace(F.regexp_replace(text, r"(?s)[^\x{10000}-\x{10FFFF}]", "x"), astral, "yy")
    excess = F.when(text.rlike(astral), (F.regexp_count(F.substring(units, F.lit(1), at - 1), F.lit("yy"))).cast("int")).otherwise(0)
    return F.when(at > 0, at - 1 - excess)


def first_place(text: Column, pattern: str, flags: str = "") -> Column:
    return place_of(text, F.lit(java_regex(pattern, flags)))


def count_matches(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, F.lit(java_regex(pattern, flags)))


def around(text: Column, place: Column, length: Column, radius: int) -> Column:
    """The match with up to ``radius`` code points on either side."""
    start = F.greatest(place - radius, F.lit(0))
    return F.substring(text, start + 1, place + length + radius - start)


def strings(values: Iterable[str]) -> Column:
    """A constant array of strings, spelled as one literal: long lists one by one take the driver longer than a query."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any word occurs as a substring (both as they are)."""
    return F.exists(strings(words), lambda w: F.contains(text, w))


def line_of(text: Column, place: Column, length: Column) -> tuple[Column, Column]:
    """The line with the match (to the first line feed after it), and the match's place in it."""
    head = F.substring_index(F.substring(text, F.lit(1), place), "\n", -1)
    tail = F.substring_index(F.substring(text, place + length + 1, F.length(text)), "\n", 1)
    return F.concat(head, F.substring(text, place + 1, length), tail), F.length(head)
