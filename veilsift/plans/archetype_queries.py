"""Queries of archetypes over documents with planted marks, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prefilter
from ..operators import archetypes as ar
from ..operators import severity as sev
from ..sources import tables
from . import archetype_words as words
from .class_queries import _re2
from .scan_queries import _list, _quoted

Query = Callable[[SparkSession, str], DataFrame]

#: What follows each text, by doc_id.
PLANTED = [
    "nothing of note", "Curriculum vitae: education, skills, work experience", "boarding pass, gate A12, seat 3C, passenger", "invoice number 12, subtotal, VAT Ltd", "patient record, diagnosis, medication and treatment", "power of attorney, notarized, affidavit",
    "employee handbook, bonus, compensation", "insurance policy, premium, claim", "report card, grades, attendance, guardian", "ROPA, data controller, legal basis, GDPR, retention period", "security policy, version history, controls, unauthorized, risk assessment",
    "security policy, SOP number, controls whereas and hereby under the governing law", "clinical guideline, dosage, contraindications, clinical trials", "headcount, budget summary, KPI, forecast, fiscal year", "premium, coverage, deductible, claim, beneficiary", "education and skills",
]
IDS = ["global-iban", "global-national-id", "registry-medical-content", "global-email", "registry-hr-employee", "global-swift", "other.id", "english-hr-compensation", "registry-icd10-code", "nordic-phone-labeled"]
CLASSES = ["doc.hr_record", "doc.legal_contract", "doc.medical_record", "doc.payroll"]


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ids = F.array(*[_pick(IDS, (i * k + k) % len(IDS)) for k in (3, 7)])
    text = F.concat_ws("\n", F.coalesce("text", F.lit("")), _pick(PLANTED, i % len(PLANTED)))
    docs = tables.spread(tables.table(spark, sf_dir, "documents")).select("doc_id", text.alias("text"), ids.alias("ids"), _pick(CLASSES, i % 4).alias("class"), _pick(sev.LEVELS, i % 5).alias("severity"))
    facts = prefilter.facts(F.col("text"))
    return docs.withColumns(facts).withColumn("found", ar.detect(F.col("text"), guarded=True)).drop(*facts)


def archetype_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archetypes of every document, in order, and what strong ones veto."""
    shown = F.transform("found", lambda m: F.concat_ws(":", m["id"], F.when(m["strong"], "strong").otherwise("weak"), m["marks"].cast("string")))
    kept = F.array_join(ar.without_generic(F.col("ids"), F.col("found")), ",")
    return planted(spark, sf_dir).select("doc_id", F.array_join(shown, ",").alias("archetypes"), ar.primary(F.col("found")).alias("main"), kept.alias("ids"), ar.vetoed_class(F.col("class"), F.col("found")).alias("class"))


def archetype_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities by the contracts of the archetypes."""
    names = F.transform("found", lambda m: m["id"])
    return planted(spark, sf_dir).withColumn("c", ar.contract(F.col("severity"), F.col("ids"), names, F.col("text"))).select("doc_id", F.array_join(ar.groups(F.col("ids")), ",").alias("groups"), "c.severity", "c.driving", "c.iban")


def _hits(patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches(text, {_re2(p, 'i')})::int" for p in patterns) + ")"


def _detect_sql() -> str:
    """(doc_id, text, ids, class, severity, ks): a key an archetype, from which strength, marks and name can be read."""
    counts, keys = [], []
    for k, a in enumerate(ar.ORDER):
        if a not in ar.SHARED:
            strong, other = words.MARKERS[a]
            counts.append(f"{_hits(strong)} AS s_{a}, {_hits(strong)} + {_hits(other)} AS t_{a}")
        of = ar.SHARED.get(a, a)
        least_strong, least, enough = ar.THRESHOLDS.get(a, (1, 2, 4))
        fits = f"t_{of} >= {least}" + (f" AND {_hits(words.CONTRACT)} < 2" if a == "policy_standard" else "")
        keys.append(f"CASE WHEN {fits} THEN (NOT (s_{of} >= {least_strong} OR t_{of} >= {enough}))::int * 1000000 + (500 - t_{of}) * 100 + {k} END")
    ids = ", ".join(f"({_list(IDS)})[((doc_id * {k} + {k}) % {len(IDS)})::int + 1]" for k in (3, 7))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || ({_list(PLANTED)})[(doc_id % {len(PLANTED)})::int + 1] AS text, [{ids}] AS ids, ({_list(CLASSES)})[(doc_id % 4)::int + 1] AS cls, ({_list(sev.LEVELS)})[(doc_id % 5)::int + 1] AS severity FROM documents),
m AS (SELECT *, {", ".join(counts)} FROM d),
k AS (SELECT doc_id, text, ids, cls, severity, CASE WHEN length(text) >= 50 THEN list_sort(list_filter([{", ".join(keys)}], lambda x: x IS NOT NULL)) ELSE [] END AS ks FROM m),
a AS (SELECT *, list_transform(ks, lambda x: ({_list(ar.ORDER)})[(x % 100)::int + 1]) AS names, list_transform(list_filter(ks, lambda x: x < 1000000), lambda x: ({_list(ar.ORDER)})[(x % 100)::int + 1]) AS strong FROM k)"""


def _documents_sql() -> str:
    vetoes = " OR ".join(f"(list_contains(strong, '{a}') AND cls IN ({', '.join(map(_quoted, cs))}))" for a, cs in ar.VETO_CLASSES.items())
    return f"""{_detect_sql()}
SELECT doc_id, array_to_string(list_transform(ks, lambda x: ({_list(ar.ORDER)})[(x % 100)::int + 1] || ':' || CASE WHEN x < 1000000 THEN 'strong' ELSE 'weak' END || ':' || (500 - x % 1000000 // 100)::varchar), ',') AS archetypes,
  names[1] AS main, array_to_string(CASE WHEN len(list_intersect(strong, {_list(ar.VETO_KEYWORDS)})) > 0 THEN list_filter(ids, lambda i: NOT list_contains({_list(ar.GENERIC_IDS)}, i)) ELSE ids END, ',') AS ids, CASE WHEN NOT ({vetoes}) THEN cls END AS class FROM a"""


def _contract_sql() -> str:
    have = ", ".join(f"CASE WHEN len(list_intersect(ids, {_list(v)})) > 0 THEN '{g}' END" for g, v in ar.GROUPS.items())
    reach = []
    for name, (floor, anchors) in ar.CONTRACTS.items():
        parts = [str(sev.LEVELS.index(floor))] + [f"CASE WHEN {' AND '.join(f'''list_contains(gs, '{g}')''' for g in needs)} THEN {sev.LEVELS.index(least)} ELSE 0 END" for needs, least in anchors]
        reach.append(f"WHEN '{name}' THEN greatest({', '.join(parts)})")
    business = " OR ".join(f"regexp_matches(text, {_re2(p, f)})" for p, f in ar.BUSINESS)
    return f"""{_detect_sql()},
g AS (SELECT *, list_filter([{have}], lambda x: x IS NOT NULL) AS gs, list_position({_list(sev.LEVELS)}, severity) - 1 AS was FROM a),
r AS (SELECT *, list_transform(names, lambda n: CASE n {" ".join(reach)} END) AS rs FROM g), w AS (SELECT *, greatest(was, coalesce(list_max(rs), 0)) AS worst FROM r),
i AS (SELECT *, worst < 3 AND list_contains(ids, 'global-iban') AND (list_contains(gs, 'identity_basic') OR list_contains(gs, 'identity_strong')) AND NOT ({business}) AS iban FROM w)
SELECT doc_id, array_to_string(gs, ',') AS groups, CASE WHEN iban THEN 'high' ELSE ({_list(sev.LEVELS)})[worst::int + 1] END AS severity, CASE WHEN worst > was THEN names[list_position(rs, worst::int)] END AS driving, iban FROM i"""


def queries() -> dict[str, Query]:
    return {"archetype_documents": archetype_documents, "archetype_contract": archetype_contract}


def oracle_sql() -> dict[str, str]:
    return {"archetype_documents": _documents_sql(), "archetype_contract": _contract_sql()}
