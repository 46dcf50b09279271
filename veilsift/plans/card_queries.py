"""Card candidates and their neighbourhoods: a hundred customers' orders make a text of about a thousand numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards
from ..sources import tables
from .scan_queries import CARD_TEST

Query = Callable[[SparkSession, str], DataFrame]

#: An order as a line of text, in SQL that both engines read alike.
LINE = """concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'pay by visa ' WHEN '2-HIGH' THEN 'clause 1.2.3.4.5 / 77-88-99 (12) ' WHEN '3-MEDIUM' THEN 'the order of the day é ' WHEN '5-LOW' THEN '12 34 56 78 90 ' ELSE 'x' END,
  CASE o_orderstatus WHEN 'F' THEN '4' WHEN 'O' THEN '5' ELSE '9' END, substr(lpad(CAST(o_orderkey AS STRING), 7, '1'), 1, 3), CASE o_orderpriority WHEN '2-HIGH' THEN '-' WHEN '3-MEDIUM' THEN ' ' WHEN '4-NOT SPECIFIED' THEN chr(10) ELSE '' END,
  substr(lpad(CAST(o_orderkey AS STRING), 7, '1'), 4, 4), CASE o_orderpriority WHEN '2-HIGH' THEN '-' WHEN '3-MEDIUM' THEN ' ' ELSE '' END, substr(lpad(CAST(o_custkey AS STRING), 8, '2'), 1, 4),
  CASE o_orderpriority WHEN '2-HIGH' THEN '-' WHEN '3-MEDIUM' THEN ' ' ELSE '' END, substr(lpad(CAST(o_custkey AS STRING), 8, '2'), 5, 4), CASE WHEN o_orderstatus = 'P' THEN ' Kreditkarte, valid thru' ELSE '.' END)"""


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 100).alias("doc_id"), F.struct("o_orderkey", F.expr(LINE).alias("line")).alias("o"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["line"]), " ").alias("text"))


def card_neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.validated(cards.candidates(order_texts(spark, sf_dir)))


def _cards_sql() -> str:
    words = ["card", "credit", "debit", "visa", "amex", "american express", "discover", "cvv", "cvc", "expiry", "expiration", "exp date", "valid thru", "valid through", "kort", "karte", "gültig bis"]
    near = " OR ".join(f"contains(window_text, '{w}')" for w in words)
    count = lambda c: f"length(regexp_replace(around, '[^{c}]', '', 'g'))::INT"
    issuer = CARD_TEST.split(" AND (", 1)[1]
    return f"""
WITH texts AS (SELECT o_custkey // 100 AS doc_id, string_agg({LINE}, ' ' ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey // 100
), cut AS (
  SELECT doc_id, text, string_split(regexp_replace(text, '(\\b[0-9]{{4}}[\\s-]?[0-9]{{4}}[\\s-]?[0-9]{{4}}[\\s-]?[0-9]{{4}}\\b)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS a FROM texts
), hits AS (
  SELECT doc_id, text, a[i] AS matched, list_sum(list_transform(a[1:i-1], lambda x: length(x)))::INT AS place FROM (SELECT *, unnest(range(2, len(a) + 1, 2)) AS i FROM cut)
), seen AS (
  SELECT *, regexp_replace(matched, '[^0-9]', '', 'g') AS s,
    substr(text, greatest(place - 40, 0) + 1, least(place, 40)) || substr(text, place + length(matched) + 1, 40) AS around,
    lower(substr(text, greatest(place - 100, 0) + 1, least(place, 100) + length(matched) + 100)) AS window_text
  FROM hits
), told AS (
  SELECT doc_id, matched, place, s, {count("A-Za-z")} AS letters, {count("0-9")} AS digits, length(regexp_replace(around, '\\S', '', 'g'))::INT AS spaces, length(around)::INT AS whole, {near} AS context,
    (length(matched) - length(s)) / length(matched) AS density, {CARD_TEST.split(" AND (", 1)[0]} AS luhn, ({issuer} AS known
  FROM seen
), judged AS (
  SELECT *, CASE WHEN contains(matched, chr(10)) THEN 'spans_line_breaks' WHEN density > 0.4 THEN 'extreme_separator_density' WHEN NOT known THEN 'no_valid_issuer_prefix'
    WHEN density > 0.2 AND digits > 2 * letters THEN 'clause_context_with_separators' ELSE 'passes_quality_checks' END AS reason
  FROM told
)
SELECT doc_id, matched, place, letters, digits, spaces, whole - letters - digits - spaces AS marks, context,
  CASE reason WHEN 'passes_quality_checks' THEN 'plausible' WHEN 'clause_context_with_separators' THEN 'low_quality' ELSE 'noise' END AS quality, reason, luhn, luhn AND known AS issuer, luhn AND known AS valid,
  CASE WHEN luhn AND known THEN CASE WHEN s[1] = '4' THEN 'visa' WHEN regexp_matches(s, '^(5[1-5]|2[2-7])') THEN 'mastercard' WHEN regexp_matches(s, '^3[47]') THEN 'amex' WHEN s[1] = '6' THEN 'discover' ELSE 'other' END END AS card_type,
  CASE WHEN NOT luhn THEN 'Failed Luhn checksum' WHEN NOT known THEN 'No known issuer prefix match' END AS rejection
FROM judged
"""


def queries() -> dict[str, Query]:
    return {"card_neighborhoods": card_neighborhoods}


def oracle_sql() -> dict[str, str]:
    return {"card_neighborhoods": _cards_sql()}
