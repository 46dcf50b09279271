"""Phone numbers of documents with planted numbers, by a locale that each document's language and length stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phones
from ..sources import tables
from .scan_queries import _list, _quoted

Query = Callable[[SparkSession, str], DataFrame]

TAILS = [
    "call 555-123-4567 or (555) 123-4567, 1-555-123-4567", "tel 01234 567890 07911 123456 x+44 1234 567890", "tlf 12 34 56 78 og a+45 12 34 56 78, 4111 1111 1111 1111, 123.456.78", "Tel 0301 1234567 y+49 301 12345678 z+41 44-123-45-67",
    "n+34 612 345 678 a+351 912 345 678 b+39 02 1234567", "t 01 23 45 67 89 c+33 1 23 45 67 89 d+31 6 12345678", "e+48 601-602-603 f+420 601 602 603 g+36 20 123 4567", "h+1 604 555 0123 i+61 4 1234 5678 j+353 85 1234567",
    "k+52 55 123 4567 l+54 11 4321 8765 m+55 11 91234 5678 n+56 9 1234 5678", "5551234567 o+123 4567890123 +45 12345678", "no numbers here", "12345678 kr 1.599,00 12 34 56 78",
]
LOCALES = [n for n in phones.FORMATS if n != "unknown"] + ["XX"]


def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    size = F.length("text")
    locale = F.when(F.col("lang") == "fr", F.lit(None).cast("string")).otherwise(F.element_at(F.array(*[F.lit(x) for x in LOCALES]), size % len(LOCALES) + 1))
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), F.floor(size / 7).cast("int") % len(TAILS) + 1)
    out = phones.with_phones(docs.select("doc_id", F.concat("text", F.lit("\n"), tail).alias("t"), locale.alias("locale")), "t")
    return out.select("doc_id", "locale", F.array_join("phones", "|").alias("phones"), "phone_count")


def _phones_sql() -> str:
    every = lambda patterns: "list_concat(" + ", list_concat(".join(f"regexp_extract_all(t, {_quoted(p)})" for p in patterns) + ", []" + ")" * len(patterns)
    cases = " ".join(f"WHEN '{n}' THEN {every(patterns)}" for n, patterns in phones.FORMATS.items() if n != "unknown")
    gone = " OR ".join(f"regexp_matches(m, {_quoted(p)})" for p in phones.EXCLUDED["EU-NORDICS"])
    return f"""
WITH d AS (SELECT doc_id, text || chr(10) || ({_list(TAILS)})[(length(text) // 7) % {len(TAILS)} + 1] AS t, CASE WHEN coalesce(lang, '') <> 'fr' THEN ({_list(LOCALES)})[length(text) % {len(LOCALES)} + 1] END AS locale FROM documents
), f AS (SELECT doc_id, locale, CASE locale {cases} ELSE {every(phones.FORMATS["unknown"])} END AS found FROM d
), k AS (SELECT doc_id, locale, CASE WHEN locale = 'EU-NORDICS' THEN list_filter(found, lambda m: NOT ({gone})) ELSE found END AS kept FROM f)
SELECT doc_id, locale, array_to_string(kept, '|') AS phones, len(kept)::INT AS phone_count FROM k
"""


def queries() -> dict[str, Query]:
    return {"phone_numbers": phone_numbers}


def oracle_sql() -> dict[str, str]:
    return {"phone_numbers": _phones_sql()}
