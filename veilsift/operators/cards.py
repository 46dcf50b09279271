"""Card-like numbers with what stands around them: every candidate of a text, its neighbourhood and its quality.

A text's characters are classed once and their counts summed up from the left, so the neighbourhood of a
candidate is one difference for each class, whatever the number of candidates. Words of payment are
found once, too: with the smallest end of all words from a place on, whether one lies in a window is a
single comparison.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import checksums as cs
from . import gates

# Code points of ECMAScript's white space.
BLANKS = [9, 10, 11, 12, 13, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_SPACE = "".join(map(chr, BLANKS))
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9_])[0-9]{{4}}[{_SPACE}-]?[0-9]{{4}}[{_SPACE}-]?[0-9]{{4}}[{_SPACE}-]?[0-9]{{4}}(?![A-Za-z0-9_])")
NEAR, CONTEXT = 40, 100

# Words of payment, as substrings in lower case.
CARD_WORDS = [
    "card", "credit", "debit", "visa", "mastercard", "amex", "american express", "discover", "cvv", "cvc", "cvv2", "cvc2", "expiry", "expiration", "exp date", "valid thru", "valid through", "cardholder", "card number", "card no",
    "payment card", "credit card", "debit card", "kort", "kreditkort", "betalingskort", "dankort", "karte", "kreditkarte", "bankkarte", "gültig bis",
]
_WORDS = re.compile("(?=(" + "|".join(sorted(map(re.escape, CARD_WORDS), key=len)) + "))")

FOUND = "matched string, place int, letters int, digits int, spaces int, marks int, context boolean"
_COUNTED = ("letters", "digits", "spaces", "marks")


def _classes(points: np.ndarray) -> np.ndarray:
    """0 letter (A-Z, a-z), 1 digit (0-9), 2 white space, 3 anything else, of code points."""
    out = np.full(len(points), 3, np.int8)
    out[(points >= 65) & (points <= 90) | (points >= 97) & (points <= 122)] = 0
    out[(points >= 48) & (points <= 57)] = 1
    out[np.isin(points, np.array(BLANKS))] = 2
    return out


def neighborhoods(text: str) -> list[tuple]:
    """FOUND of each candidate of a text, from left to right."""
    spans = [m.span() for m in CANDIDATE.finditer(text)]
    if not spans:
        return []
    n = len(text)
    classes = _classes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    sums = np.zeros((4, n + 1), np.int32)
    for c in range(4):
        np.cumsum(classes == c, out=sums[c, 1:])
    start, end = (np.array(x) for x in zip(*spans, strict=True))
    low, high = np.maximum(start - NEAR, 0), np.minimum(end + NEAR, n)
    near = sums[:, start] - sums[:, low] + sums[:, high] - sums[:, end]
    # lower case may be longer than the text for one letter only, which no word of payment holds
    words = [(m.start(), m.end(1)) for m in _WORDS.finditer(text.replace("İ", "i").lower())]
    begins = np.array([a for a, _ in words] + [n + 1])
    least = np.minimum.accumulate(np.array([b for _, b in words] + [n + CONTEXT + 1])[::-1])[::-1]
    context = least[np.searchsorted(begins, np.maximum(start - CONTEXT, 0))] <= np.minimum(end + CONTEXT, n)
    return [(text[a:b], a, *map(int, near[:, i]), bool(context[i])) for i, (a, b) in enumerate(spans)]


def candidates(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row a candidate: ``keep`` and FOUND (counts of the 40 characters on either side, words of payment within 100).

    Places are code points from 0. Null and empty texts give no rows. A text costs its length once and
    a constant for each candidate.
    """
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                lists = [neighborhoods(t) if t else [] for t in batch.column(len(keep)).to_pylist()]
                own = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in lists]))
                columns = list(zip(*[r for x in lists for r in x], strict=True)) or [()] * 7
                kinds = [pa.string(), *[pa.int32()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(own) for i in range(len(keep))], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*keep, *[f.split()[0] for f in FOUND.split(", ")]])

    plain = df.select(*keep, F.col(text_col).alias("__text"))
    return plain.mapInArrow(run, StructType([*plain.select(*keep).schema.fields, *StructType.fromDDL(FOUND).fields]))


def quality() -> tuple[Column, Column]:
    """(quality, reason) of a candidate from FOUND: plausible, low_quality or noise."""
    m = F.col("matched")
    digits = F.regexp_replace(m, "[^0-9]", "")
    density = (F.length(m) - F.length(digits)) / F.length(m)
    clauses = F.col("digits") > 2 * F.col("letters")
    reason = (
        F.when(m.rlike(r"[\r\n]"), "spans_line_breaks").when(density > 0.4, "extreme_separator_density")
        .when(F.length(digits).between(13, 19) & ~F.coalesce(gates.issuer_prefix(digits), F.lit(False)), "no_valid_issuer_prefix").when((density > 0.2) & clauses, "clause_context_with_separators").otherwise("passes_quality_checks")
    )
    return F.when(reason == "passes_quality_checks", "plausible").when(reason == "clause_context_with_separators", "low_quality").otherwise("noise"), reason


def validated(df: DataFrame) -> DataFrame:
    """Candidates with quality, reason, luhn, issuer, valid, card_type (null where not valid) and rejection (null where valid)."""
    digits = F.regexp_replace("matched", "[^0-9]", "")
    sized = F.length(digits).between(13, 19)
    luhn = sized & cs.luhn10(digits)
    issuer = luhn & F.coalesce(gates.issuer_prefix(digits), F.lit(False))
    told, reason = quality()
    kind = F.when(digits.startswith("4"), "visa").when(digits.rlike("^(?:5[1-5]|2[2-7])"), "mastercard").when(digits.rlike("^3[47]"), "amex").when(digits.startswith("6"), "discover").otherwise("other")
    rejection = F.when(~sized, "Invalid length (must be 13-19 digits)").when(~luhn, "Failed Luhn checksum").when(~issuer, "No known issuer prefix match")
    return df.select("*", told.alias("quality"), reason.alias("reason"), luhn.alias("luhn"), issuer.alias("issuer"), issuer.alias("valid"), F.when(issuer, kind).alias("card_type"), rejection.alias("rejection"))
