"""Queries of document classes over documents with planted words, and their DuckDB SQL.

The SQL spells expressions with RE2: look-around for letters becomes an alternative, which tells the
same texts apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prefilter
from ..operators import classes as cl
from ..sources import tables
from . import class_words as words
from .scan_queries import _list, _quoted

Query = Callable[[SparkSession, str], DataFrame]

#: What follows each text, by doc_id.
PLANTED = [
    "nothing of note", "Payslip for the pay period, net pay and gross pay", "employment contract with a probation period", "performance review, job offer, salary band",
    "insurance policy of the policyholder, premium amount and deductible", "patient id 12, diagnosis of the patient, medical history", "Invoice number 77, due date, VAT, subtotal", "COVID vaccination, passport, date of birth",
    "1.1 scope 1.2 terms 1.3 fees 1.4 rent 2.1 law 2.2 end. Date: ____ Dato: ____ hereinafter Party A and Party B", "Boarding pass, flight number 22, seat 12A, gate 4", "Curriculum vitae, work history and career summary",
    "Flight: SK1234, e-ticket. Wire transfer to the account, payment details", "løn: lønseddel og månedsløn", "nómina y salario bruto", "sjukjournal, läkarjournal and diagnose, personnummer", "gross pay, allowances; termination and disciplinary, exit interview",
    "docusign envelope id 9. Party 1 and second party hereinafter, Clause 1 Clause 2 Clause 3 _____", "póliza de seguro, asegurado, siniestro", "faktura 12, moms, beløb and iban",
]
#: Ids of signals, dealt out in threes.
IDS = [
    "pii.compensation", "global-national-id", "registry-credit-card-spaced", "pii.name", "financial.iban", "global-insurance-policy-number", "registry-banking-terms", "secret.url_with_credentials", "legal.nda",
    "registry-icd10-code", "global-swift", "global-ma-terms", "financial.cvv", "global-dob", "structure.signature_block", "other.id", "hr-performance",
]
NAMES = ["notes.txt", "patient_record.pdf", "service_agreement.pdf", "docusign_contract.pdf", "scan.png", "medical_history.docx", "cv.pdf"]


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = tables.spread(tables.table(spark, sf_dir, "documents")), F.col("doc_id")
    ids = F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(*[_pick(IDS, (i * k + k) % len(IDS)) for k in (3, 5, 11)]))
    return docs.select("doc_id", F.concat_ws("\n", F.coalesce("text", F.lit("")), _pick(PLANTED, i % len(PLANTED))).alias("text"), ids.alias("ids"), _pick(NAMES, i % len(NAMES)).alias("filename"))


def _re2(p: str, f: str) -> str:
    p = p.replace(r"(?<!\p{L})", r"(?:^|[^\p{L}])").replace(r"(?!\p{L})", r"(?:$|[^\p{L}])")
    return _quoted((f"(?{f})" if f else "") + p)


def _hits(text: str, patterns: list[tuple[str, str]]) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, {_re2(p, f)})::int" for p, f in patterns) + ")"


def _count(text: str, strong: list, plain: list) -> str:
    return f"CASE WHEN {_hits(text, strong)} > 0 THEN 3 ELSE {_hits(text, plain)} END" if strong else _hits(text, plain)


def _points(strong: list, weak: list) -> str:
    return f"CASE WHEN length(text) >= 50 AND {_hits('text', strong)} > 0 THEN 3 * {_hits('text', strong)} + {_hits('text', weak)} ELSE 0 END"


def _structure_sql() -> str:
    plain = [(p, f) for p, f in words.CLAUSES if "(?!" not in p]
    found = [f"regexp_extract_all(text, {_re2(p, f)})" for p, f in plain]
    # two-level numbers: the last two levels of a run of numbers
    found.append(r"list_transform(regexp_extract_all(text, '\b\d+(?:\.\d+)+\b'), lambda x: regexp_extract(x, '\d+\.\d+$'))")
    clauses = f"len(list_distinct(flatten([{', '.join(found)}])))"
    name = "replace(lower(filename), '_', ' ')"
    signed, parties = _hits("text", words.SIGNATURES), _hits("text", words.PARTIES)
    return f"""CASE WHEN length(text) < 200 THEN 0 ELSE
      CASE WHEN {clauses} >= 10 THEN 4 WHEN {clauses} >= 6 THEN 3 WHEN {clauses} >= 3 THEN 1 ELSE 0 END + CASE WHEN {signed} >= 2 THEN 3 ELSE {signed} END
      + CASE WHEN {_hits("text", words.E_SIGNATURES)} > 0 THEN 2 ELSE 0 END + CASE WHEN regexp_matches({name}, 'contract|kontrakt|avtale|aftale|agreement|vertrag') THEN 2 ELSE 0 END
      + CASE WHEN regexp_matches({name}, 'docusign|hellosign|adobesign|pandadoc') THEN 2 ELSE 0 END + least({parties}, 2) END"""


PLANTED_SQL = f"""SELECT doc_id, coalesce(text, '') || chr(10) || ({_list(PLANTED)})[(doc_id % {len(PLANTED)})::int + 1] AS text, ({_list(NAMES)})[(doc_id % {len(NAMES)})::int + 1] AS filename,
  CASE WHEN doc_id % 4 = 0 THEN []::varchar[] ELSE [{", ".join(f"({_list(IDS)})[((doc_id * {k} + {k}) % {len(IDS)})::int + 1]" for k in (3, 5, 11))}] END AS ids FROM documents"""

_T, _N = "replace(text, '_', ' ')", "replace(filename, '_', ' ')"
MARKERS_SQL = f"""SELECT *, {_count("text", words.STRONG_PAYROLL, words.PAYROLL)} AS payroll_words, {_count("text", words.STRONG_HR, words.HR)} AS hr_words, {_hits("text", words.INSURANCE)} AS insurance_words,
  {_count(_T, words.STRONG_MEDICAL, words.MEDICAL)} AS medical_words, {_count(_N, words.STRONG_MEDICAL, words.MEDICAL)} AS name_words, {_points(words.INVOICE_STRONG, words.INVOICE_WEAK)} AS invoice_points,
  {_points(words.CERTIFICATE_STRONG, words.CERTIFICATE_WEAK)} AS certificate_points, {_structure_sql()} AS structure_points, {_hits("text", words.PATIENT)} > 0 OR {_hits(_N, words.PATIENT)} > 0 AS patient_words,
  length(text) >= 50 AND {_hits("text", words.TICKET)} >= 2 AS ticket, length(text) >= 100 AND {_hits("text", words.RESUME)} >= 2 AS resume, length(text) >= 20 AND {_hits("text", words.TRANSFER)} > 0 AS transfer
FROM ({PLANTED_SQL})"""


def _of(known: list[str]) -> str:
    return f"len(list_distinct(list_filter(ids, lambda i: list_contains({_list(known)}, i))))"


def _anchored_sql() -> str:
    primary = {k: f"({_of(v)} + ({k}_words >= 2)::int" + (" + (name_words >= 2)::int" if k == "medical" else "") + ")" for k, v in cl.PRIMARY.items()}
    columns = ", ".join(f"{primary[k]} AS p_{k}, 3 * {primary[k]} + {_of(cl.SUPPORTING[k])} + ({k}_words > 2)::int AS s_{k}" for k in primary)
    count = " ".join(f"WHEN '{k}' THEN {_of(v)}" for k, v in cl.CORROBORATING.items())
    keep = lambda known: f"list_filter(list_distinct(ids), lambda i: list_contains({_list(known)}, i))"
    has = lambda part: f"len(list_filter(ids, lambda i: contains(i, '{part}'))) > 0"
    baseline = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cl.BASELINES.items())
    strong, terms = (" ".join(f"WHEN '{k}' THEN {_quoted(v[i])}" for k, v in cl.LABELS.items()) for i in (0, 1))
    return f"""
WITH m AS ({MARKERS_SQL}), s AS (SELECT *, {columns}, {_of(cl.PATIENT_IDS)} > 0 OR patient_words AS patient_context FROM m),
c AS (SELECT *, CASE WHEN p_medical > 0 AND patient_context THEN 'doc.medical_record' WHEN p_payroll > 0 AND p_hr > 0 THEN CASE WHEN s_payroll > s_hr THEN 'doc.payroll' ELSE 'doc.hr_record' END WHEN p_payroll > 0 THEN 'doc.payroll'
  WHEN p_hr > 0 THEN 'doc.hr_record' WHEN p_insurance > 0 THEN 'doc.insurance_policy' WHEN invoice_points >= 4 THEN 'doc.invoice' WHEN certificate_points >= 4 THEN 'doc.health_certificate' WHEN structure_points >= 5 THEN 'doc.legal_contract' END AS document_class FROM s),
n AS (SELECT *, CASE document_class {count} END AS n FROM c),
i AS (SELECT *, CASE WHEN document_class IS NULL THEN 'none' WHEN n >= 2 OR (n >= 1 AND document_class IN ('doc.invoice', 'doc.health_certificate')) OR (document_class = 'doc.medical_record' AND patient_context)
  OR (document_class IN ('doc.hr_record', 'doc.payroll') AND {_of(["pii.compensation", "hr-compensation"])} > 0) OR (document_class = 'doc.insurance_policy' AND list_contains(ids, 'global-insurance-policy-number')) THEN 'strong' ELSE 'weak' END AS identity_confidence FROM n)
SELECT doc_id, document_class, patient_context, identity_confidence, CASE document_class {baseline} END AS baseline, CASE WHEN identity_confidence = 'strong' THEN CASE document_class {strong} END ELSE CASE document_class {terms} END END AS class_label,
  list_aggregate(list_sort(CASE WHEN document_class IS NOT NULL THEN list_concat(list_concat(CASE WHEN {has("cvv")} OR {has("expiry")} OR {has("cardholder")} THEN [] ELSE {keep(cl.CARD_NOISE)} END,
    CASE WHEN document_class IN ('doc.payroll', 'doc.hr_record') THEN {keep(cl.URL_NOISE)} ELSE [] END), CASE WHEN {has("pii.")} OR {has("employee")} OR {has("name")} THEN [] ELSE {keep(cl.SWIFT_NOISE)} END)
    WHEN ticket THEN CASE WHEN transfer THEN {keep([k for k in cl.TICKET_NOISE if not k.endswith("iban")])} ELSE {keep(cl.TICKET_NOISE)} END WHEN resume THEN {keep(cl.RESUME_NOISE)} ELSE [] END), 'string_agg', ',') AS noise FROM i"""


def class_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the words of every text and name say."""
    facts = prefilter.facts(F.col("text"))
    return cl.markers(planted(spark, sf_dir).withColumns(facts), filename_col="filename", guarded=True).drop("text", "filename", "ids", *facts)


def class_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, with its baseline, identity and noise."""
    out = cl.anchored(planted(spark, sf_dir), filename_col="filename")
    noise = F.when(F.size("noise_ids") > 0, F.array_join("noise_ids", ","))
    return out.select("doc_id", "document_class", "patient_context", "identity_confidence", "baseline", "class_label", noise.alias("noise"))


def class_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities raised to the baseline of a class."""
    e, kinds = F.col("event_id"), [*cl.BASELINES, None]
    cls = F.element_at(F.array(*[F.lit(k) for k in kinds]), (e % len(kinds)).cast("int") + 1)
    severity = _pick(["none", "low", "medium", "high", "critical"], F.col("user_id") % 5)
    return tables.table(spark, sf_dir, "events").select("event_id", cl.with_floor(severity, cls).alias("severity"))


def _floor_sql() -> str:
    levels, kinds = _list(["none", "low", "medium", "high", "critical"]), ", ".join(map(_quoted, cl.BASELINES.values()))
    return f"""SELECT event_id, ({levels})[greatest((user_id % 5)::int + 1, coalesce(list_position({levels}, ([{kinds}, NULL])[(event_id % {len(cl.BASELINES) + 1})::int + 1]), 0))] AS severity FROM events"""


def queries() -> dict[str, Query]:
    return {"class_markers": class_markers, "class_documents": class_documents, "class_floor": class_floor}


def oracle_sql() -> dict[str, str]:
    return {"class_markers": f"SELECT * EXCLUDE (text, filename, ids) FROM ({MARKERS_SQL})", "class_documents": _anchored_sql(), "class_floor": _floor_sql()}
