"""Queries of rule tables: thousands of rules made from the words of the conversations, over whole documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rule_table
from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]

_WORD = "[a-z]{8,}"


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each long word of the conversations, of a kind told by its hash, and one of several keywords for each first three letters."""
    texts = tables.table(spark, sf_dir, "conversations").select("text")
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("w")).distinct()
    kind = F.substring(F.md5("w"), 1, 1)
    null = F.lit(None).cast("string")
    sensitive = kind.isin("4", "5", "6", "7")
    regex = F.when(kind.isin("8", "9", "a"), F.concat(F.lit(r"\b"), "w", F.lit(r"[a-z]*\b"))).when(kind.isin("b", "c"), F.concat(F.lit(r"\b(?:in|of|the)\s+"), "w")).when(kind.isin("d", "e", "f"), F.concat("w", F.lit(r"[.,;]\s+[A-Z][a-z]+")))
    single = words.select(
        F.concat(F.lit("w:"), "w").alias("id"), F.when(regex.isNull(), "keyword").otherwise("regex").alias("type"), F.lit("high").alias("severity"), F.lit("word").alias("category"),
        regex.alias("regex"), F.when(regex.isNull(), F.array("w")).alias("keywords"), sensitive.alias("case_sensitive"), kind.isin("2", "3", "6", "7").alias("whole_word"), F.lit(True).alias("enabled"),
    )
    stem = F.substring("w", 1, 3)
    groups = words.groupBy(stem.alias("stem")).agg(F.sort_array(F.collect_set("w")).alias("keywords")).select(
        F.concat(F.lit("s:"), "stem").alias("id"), F.lit("keyword").alias("type"), F.lit("low").alias("severity"), F.lit("stem").alias("category"), null.alias("regex"), "keywords", F.lit(False).alias("case_sensitive"), F.lit(True).alias("whole_word"), F.lit(True).alias("enabled"),
    )
    return single.union(groups)


def rule_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    return rule_table.scan_with_rules(docs, word_rules(spark, sf_dir))


#: Each rule as an RE2 expression with a literal that a text must hold; expressions run where it does.
RULE_SQL = r"""
WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{8,}')) AS w FROM conversations
), kinds AS (SELECT w, substr(md5(w), 1, 1) AS k FROM words
), rules AS (
  SELECT 'w:' || w AS rule_id, 'high' AS severity, 'word' AS category, w AS literal,
    CASE WHEN k IN ('4', '5', '6', '7') THEN '' ELSE '(?i)' END || CASE
      WHEN k IN ('8', '9', 'a') THEN '\b' || w || '[a-z]*\b'
      WHEN k IN ('b', 'c') THEN '\b(?:in|of|the)\s+' || w
      WHEN k IN ('d', 'e', 'f') THEN w || '[.,;]\s+[A-Z][a-z]+'
      WHEN k IN ('2', '3', '6', '7') THEN '\b' || w || '\b'
      ELSE w END AS regex
  FROM kinds
), stems AS (
  SELECT 's:' || substr(w, 1, 3) AS rule_id, 'low' AS severity, 'stem' AS category, substr(w, 1, 3) AS literal,
    '(?i)\b(?:' || string_agg(w, '|' ORDER BY length(w) DESC, w) || ')\b' AS regex
  FROM words GROUP BY ALL
), whole AS (SELECT doc_id, text, lower(text) AS folded FROM documents
), likely AS (
  SELECT doc_id, text, rule_id, severity, category, regex FROM whole JOIN rules ON contains(folded, literal)
), tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(folded, '[a-z]{8,}')) AS w FROM whole
), likely_stems AS (
  SELECT whole.doc_id, text, rule_id, severity, category, regex FROM (SELECT DISTINCT t.doc_id, substr(t.w, 1, 3) AS literal FROM tokens t JOIN words USING (w)) JOIN stems USING (literal) JOIN whole USING (doc_id)
), found AS (
  SELECT *, regexp_extract_all(text, regex) AS hits FROM (FROM likely UNION ALL FROM likely_stems)
)
SELECT doc_id, rule_id, severity, category, CAST(len(hits) AS INT) AS n, hits[1] AS matched,
  CAST(length(regexp_extract(text, '(?s)^(.*?)' || regex, 1)) AS INT) AS place
FROM found WHERE len(hits) > 0
"""


def queries() -> dict[str, Query]:
    return {"rule_table_scan": rule_table_scan}


def oracle_sql() -> dict[str, str]:
    return {"rule_table_scan": RULE_SQL}
