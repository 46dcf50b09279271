"""The fallback for unreadable documents over made names and metadata, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import degraded as dg
from ..sources import tables
from .scan_queries import _list, _quoted

Query = Callable[[SparkSession, str], DataFrame]

NAMES = ["payslip-2024.pdf", "scan0001.pdf", "employment_contract_final.docx", "Police-forsikring.pdf", "Lön_2024.pdf", "nómina-enero.pdf", "notes.txt", "salaryreport.pdf", "umowa o pracę.pdf", "busta-paga.pdf", "coverage.md"]
METADATA = ["Annual report", "Payroll March", "Contrato de trabajo", "premium and claim", "", "Kündigung Mitarbeiter", "employé", "Prima de seguro"]
QUALITIES = ["clean", "degraded", "blocked", "partial", "degraded"]


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def degraded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    c = dg.classify(_pick(NAMES, e % len(NAMES)), _pick(METADATA, (e + u) % len(METADATA)), _pick(QUALITIES, u % len(QUALITIES)))
    events = tables.spread(tables.table(spark, sf_dir, "events").select("event_id", "user_id"))
    return events.withColumn("c", c).select("event_id", "c.applied", "c.document_class", "c.severity", "c.source", F.array_join("c.tokens", ",").alias("tokens"), "c.domain", "c.disclaimer")


def _sql() -> str:
    form = lambda x: f"trim(regexp_replace(replace(replace(lower({x}), '-', ' '), '_', ' '), '\\.[a-z]{{2,4}}$', ''))"
    at = lambda values, i: f"({_list(values)})[({i})::int + 1]"
    hits = lambda x, v: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, {_quoted('(?i)' + dg.token_pattern(t))}) THEN {_quoted(t)} END" for t in dg.tokens_of(v)) + "], lambda t: t IS NOT NULL)"
    lists = ", ".join(f"{hits('a', v)} AS a{k}, {hits('m', v)} AS m{k}" for k, (*_, v) in enumerate(dg.CLASSES))
    has = lambda k: f"q AND len(a{k}) + len(m{k}) > 0"
    case = lambda f, other: "CASE " + " ".join(f"WHEN {has(k)} THEN {f(k)}" for k in range(3)) + f" ELSE {other} END"
    merged = lambda k: f"array_to_string(list_concat(list_filter(a{k}, lambda t, i: list_position(a{k}, t) = i), list_filter(m{k}, lambda t, i: list_position(m{k}, t) = i AND NOT list_contains(a{k}, t))), ',')"
    return f"""
WITH e AS (SELECT event_id, {form(at(NAMES, f"event_id % {len(NAMES)}"))} AS a, {form(at(METADATA, f"(event_id + user_id) % {len(METADATA)}"))} AS m, {at(QUALITIES, f"user_id % {len(QUALITIES)}")} IN ('degraded', 'blocked') AS q FROM events),
h AS (SELECT event_id, q, {lists} FROM e)
SELECT event_id, {case(lambda k: "TRUE", "FALSE")} AS applied, {case(lambda k: _quoted(dg.CLASSES[k][0]), "NULL")} AS document_class, {case(lambda k: _quoted(dg.CLASSES[k][1]), "'low'")} AS severity,
  {case(lambda k: f"CASE WHEN len(a{k}) > 0 AND len(m{k}) > 0 THEN 'both' WHEN len(a{k}) > 0 THEN 'filename' ELSE 'metadata' END", "NULL")} AS source, {case(merged, "''")} AS tokens,
  {case(lambda k: _quoted(dg.CLASSES[k][2]), "NULL")} AS domain, {case(lambda k: _quoted(dg.DISCLAIMER), "''")} AS disclaimer FROM h"""


def queries() -> dict[str, Query]:
    return {"degraded_documents": degraded_documents}


def oracle_sql() -> dict[str, str]:
    return {"degraded_documents": _sql()}
