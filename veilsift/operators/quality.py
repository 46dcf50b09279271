"""How well a text was extracted from its file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import count_matches, java_regex

# Thresholds, and the characters of a readable word.
LEAST_LENGTH, SAMPLE = 50, 2000
TOKEN_RATIO, BLOCKED, DEGRADED, PARTIAL = 0.3, 0.4, 0.2, 0.05
RESCUED, FULLY_RESCUED = 0.6, 0.8
READABLE = r"""^[a-zA-ZÀ-ÿĀ-ſ0-9.,;:!?()\-\/'"@#$%&*+=]+$"""
READABLE_RE2 = r"""^[a-zA-Z\x{C0}-\x{FF}\x{100}-\x{17F}0-9.,;:!?()\-/''"@#$%&*+=]+$"""
UNPRINTABLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F�]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, java_regex(r"\s+")), lambda w: w != "")


def readable_ratio(text: Column) -> Column:
    words = _words(text)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: w.rlike(java_regex(READABLE)))) / F.size(words))


def extraction_quality(text: Column) -> Column:
    """clean, partial, degraded, blocked or empty: from file syntax, unprintable characters, readable words and lone letters."""
    # texts without a word of the syntax, nearly all, are neither searched nor split
    syntax = reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in ("endobj", "endstream", "/Filter", "/FlateDecode", "xref")])
    tokens = F.when(syntax, count_matches(text, r"\b(endobj|endstream|\/Filter|\/FlateDecode|xref)\b") / F.greatest(F.size(F.split(text, java_regex(r"\s+"))), F.lit(1))).otherwise(0.0)
    sample = F.substring(text, 1, SAMPLE)
    bad = (F.length(sample) - F.length(F.regexp_replace(sample, UNPRINTABLE, ""))) / F.greatest(F.length(sample), F.lit(1))
    good, words = readable_ratio(text), _words(sample)
    single = F.size(F.filter(words, lambda w: F.length(w) == 1)) / F.size(words)
    return (
        F.when(text.startswith("%PDF-"), "blocked")
        .when(F.length(text) < LEAST_LENGTH, "empty")
        .when(tokens >= TOKEN_RATIO, "degraded")
        .when(bad >= BLOCKED, F.when(good >= FULLY_RESCUED, "partial").when(good >= RESCUED, "degraded").otherwise("blocked"))
        .when(bad >= DEGRADED, F.when(good >= RESCUED, "partial").otherwise("degraded"))
        .when(bad >= PARTIAL, "partial")
        .when((F.size(words) >= 10) & (single > 0.5), "degraded")
        .otherwise("clean")
    )
