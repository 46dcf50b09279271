"""Phone numbers by the formats of a text's own locale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import found, java_regex

# Formats of phone numbers by locale, in order; other locales count as unknown.
FORMATS: dict[str, list[str]] = {
    "US": [r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\(\d{3}\)\s*\d{3}[-.]?\d{4}\b", r"\b1[-.]?\d{3}[-.]?\d{3}[-.]?\d{4}\b"],
    "UK": [r"\b0\d{4}\s?\d{6}\b", r"\b\+44\s?\d{4}\s?\d{6}\b", r"\b07\d{3}\s?\d{6}\b"],
    "EU-NORDICS": [r"\b\+45\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}\b", r"\b\d{2}\s?\d{2}\s?\d{2}\s?\d{2}\b", r"\b\+46\s?\d{2,3}[-\s]?\d{6,7}\b", r"\b\+47\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}\b"],
    "EU-DACH": [r"\b\+49\s?\d{3,4}[-\s]?\d{6,8}\b", r"\b0\d{3,4}[-\s/]?\d{6,8}\b", r"\b\+43\s?\d{3,4}[-\s]?\d{6,8}\b", r"\b\+41\s?\d{2}[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}\b"],
    "EU-SOUTHERN": [r"\b\+34\s?\d{3}[-\s]?\d{3}[-\s]?\d{3}\b", r"\b\+39\s?\d{2,3}[-\s]?\d{6,7}\b", r"\b\+351\s?\d{3}[-\s]?\d{3}[-\s]?\d{3}\b"],
    "EU-WESTERN": [r"\b\+33\s?\d[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{2}\b", r"\b0\d[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{2}\b", r"\b\+32\s?\d{3}[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{2}\b", r"\b\+31\s?\d[-\s]?\d{8}\b"],
    "EU-EASTERN": [r"\b\+48\s?\d{3}[-\s]?\d{3}[-\s]?\d{3}\b", r"\b\+420\s?\d{3}[-\s]?\d{3}[-\s]?\d{3}\b", r"\b\+36\s?\d{2}[-\s]?\d{3}[-\s]?\d{4}\b"],
    "EN-COMMONWEALTH": [r"\b\+1[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{4}\b", r"\b\+61\s?\d[-\s]?\d{4}[-\s]?\d{4}\b", r"\b\+64\s?\d[-\s]?\d{3}[-\s]?\d{4}\b", r"\b\+353\s?\d{2,3}[-\s]?\d{6,7}\b"],
    "LATAM": [r"\b\+52\s?\d{2,3}[-\s]?\d{3}[-\s]?\d{4}\b", r"\b\+54\s?\d{2,3}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b\+55\s?\d{2}[-\s]?\d{4,5}[-\s]?\d{4}\b", r"\b\+56\s?\d[-\s]?\d{4}[-\s]?\d{4}\b"],
    "unknown": [r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\+\d{1,3}[-\s]?\d{6,12}\b"],
}
# What takes a match out again: product codes, prices, card numbers.
EXCLUDED: dict[str, list[str]] = {"EU-NORDICS": [r"\b\d{3}\.\d{3}\.\d{2}\b", r"\b\d+[.,]\d{2}\s*(kr|DKK|NOK|SEK)?\b", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"]}


def _outside(patterns: list[str]):
    """None of the patterns occurs in a match."""

    def test(m: Column) -> Column:
        out = F.lit(True)
        for p in patterns:
            out = out & ~found(m, p)
        return out

    return test


def phone_numbers(text: Column, locale: Column) -> Column:
    """All matches of the formats of a row's locale, format by format; what two formats match comes twice.

    Only the branch of the row's own locale is evaluated. Null and empty texts give an empty array, a
    null locale counts as unknown.
    """
    out = None
    for name in ["unknown", *[n for n in FORMATS if n != "unknown"]]:
        every = F.concat(*[F.regexp_extract_all(text, F.lit(java_regex(p)), F.lit(0)) for p in FORMATS[name]])
        if name in EXCLUDED:
            every = F.filter(every, _outside(EXCLUDED[name]))
        out = every if out is None else F.when(locale == name, every).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def with_phones(df: DataFrame, text_col: str = "text", locale_col: str = "locale", out_col: str = "phones", count_col: str = "phone_count") -> DataFrame:
    """``df`` with a text's phone numbers and how many there are, as the policies read it."""
    return df.withColumn(out_col, phone_numbers(F.col(text_col), F.col(locale_col))).withColumn(count_col, F.size(out_col))
