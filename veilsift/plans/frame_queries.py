"""Framed explanations over what the plain rules find in documents, their sources standing for classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames, scan
from ..operators import severity as sev
from ..sources import tables
from .scan_queries import PROBED_SQL, _list, _presence_sql, _quoted, plain_rules, probed

Query = Callable[[SparkSession, str], DataFrame]

CLASSES = ["doc.medical_record", "doc.payroll", "doc.hr_record", "doc.insurance_policy", "doc.invoice", "doc.health_certificate", "doc.legal_contract"]
NAMES = ["Contract_v2.pdf", "løn maj.xlsx", "patient-journal.docx", "notes.txt", "POLICE 12.pdf", "Overview.md", "resignation.docx"]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: what the rules find, and what its source, language and length stand for."""
    found = scan.scan(probed(spark, sf_dir), plain_rules(False), text_col="t").groupBy("doc_id").agg(F.array_sort(F.collect_list("pattern_id")).alias("driving_ids"), F.max(sev.rank(F.col("severity"))).alias("r"))
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    n, size = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.length("text")
    return docs.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("driving_ids", F.array().cast("array<string>")).alias("driving_ids"), sev.level(F.coalesce("r", F.lit(0))).alias("severity"),
        F.when(F.col("lang") == "de", F.get(F.array(*[F.lit(c) for c in CLASSES]), n % 10)).alias("document_class"), F.when(size % 3 == 0, "strong").when(size % 3 == 1, "weak").alias("identity_confidence"),
        (size % 5 == 0).alias("pdf_failed"), (size % 10 == 0).alias("password_required"), (size % 7 == 0).alias("not_scanned"), F.when(size % 25 == 0, "payroll").when(size % 25 == 5, "insurance").when(size % 25 == 10, "hr_contract").alias("degraded_domain"),
        (size % 4 == 0).alias("ontology_driven"), ((size % 6 == 0) & (F.size(F.coalesce("driving_ids", F.array().cast("array<string>"))) == 1)).alias("single_strong"), F.get(F.array(*[F.lit(c) for c in NAMES]), n % len(NAMES)).alias("filename"),
    )


def framed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.framed(facts(spark, sf_dir))
    return out.select("doc_id", "frame", "frame_rule", "frame_confidence", "frame_hint", "frame_headline", "frame_summary", "frame_guidance", "suppress_details", "suppress_rule")


def frame_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents are told each headline and summary, and what is wrong with these texts."""
    out = frames.framed(facts(spark, sf_dir))
    issues = frames.text_issues(F.col("frame_headline"), F.col("frame_summary"))
    return out.withColumn("issues", F.array_join(issues, "; ")).withColumn("whole", frames.complete(out)).groupBy("frame_headline", "frame_summary", "issues", "whole").agg(F.count(F.lit(1)).alias("documents"))


def _framed_sql() -> str:
    some = lambda parts, i="i": "(" + " OR ".join(f"contains(lower({i}), {_quoted(p)})" for p in parts) + ")"
    has = lambda parts: f"(len(list_filter(ids, lambda i: {some(parts)})) > 0)"
    regulated, legal = ["coa-", "icd", "clinical", "registry-", "pii.", "financial."], ["legal.", "contract", "nda", "agreement", "privileged"]
    secrets = ["global-api-key", "global-bearer-token", "global-aws-access-key", "global-password", "global-private-key", "global-connection-string", "global-url-credentials", "global-ma-terms"]
    shared = ["global-confidential-en", "global-confidential-de", "global-confidential-fr", "global-confidential-es", "global-confidential-nordic", "english-gov-clearance", "romance-confidential", "nordic-confidential"]
    business = ["global-ma-terms", "global-ma-valuation", "global-financial-report"]
    strong = ["medical", "clinical", "icd", "cpt", "nda", "contract", "ssn", "passport", "card-", "iban", "api-key", "password"]
    families = [
        ("medical", ["medical", "health", "clinical", "icd", "coa-", "patient", "diagnosis", "prescription"]), ("legal", ["legal.", "contract", "nda", "agreement", "privileged", "attorney", "litigation"]),
        ("financial", ["financial.", "banking", "iban", "credit_card", "payment", "invoice", "salary", "compensation"]), ("personal", ["pii.", "ssn", "national_id", "phone", "email", "address", "dob", "employee"]),
        ("HR", ["hr.", "employee", "payroll", "benefits", "performance", "termination"]), ("credentials", ["secret.", "api_key", "password", "private_key", "bearer_token", "connection_string"]),
    ]
    family = "CASE " + " ".join(f"WHEN {some(parts)} THEN '{label}'" for label, parts in families) + " END"
    hints = [("contract_like", "contract"), ("contract_like", "nda"), ("hr_like", "resign"), ("financial_like", "løn"), ("medical_like", "patient"), ("insurance_like", "police"), ("public_like", "overview")]
    hint = "CASE " + " ".join(f"WHEN contains(lower(filename), '{p}') THEN '{h}'" for h, p in hints) + " END"
    texts = "VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else _quoted(x) for x in f) + ")" for f in frames.FRAMES)
    tips = "VALUES " + ", ".join(f"({_quoted(h[0])}, {_quoted(h[2])}, {_quoted(h[3])})" for h in frames.HINTS)
    return f"""
WITH p AS ({PROBED_SQL}), s AS ({_presence_sql()}
), g AS (SELECT doc_id, list(pattern_id ORDER BY pattern_id) AS ids, max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS r FROM s GROUP BY doc_id
), f AS (
  SELECT doc_id, coalesce(ids, []) AS ids, coalesce(r, 0) AS r, length(text) AS z, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n,
    CASE WHEN lang = 'de' THEN ({_list(CLASSES)})[n % 10 + 1] END AS c, CASE z % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' END AS identity,
    ({_list(NAMES)})[n % {len(NAMES)} + 1] AS filename
  FROM documents LEFT JOIN g USING (doc_id)
), k AS (
  SELECT *, {hint} AS hint, list_sort(list_distinct(list_filter(list_transform(ids, lambda i: {family}), lambda x: x IS NOT NULL))) AS fam FROM f
), q AS (
  SELECT *, CASE WHEN c IS NOT NULL THEN 'confirmed' WHEN len(ids) = 0 THEN 'fallback' WHEN r >= 3 AND len(ids) >= 2 THEN 'confirmed' WHEN len(fam) >= 2 OR {has(strong)} THEN 'confirmed' ELSE 'inferred' END AS conf,
    CASE len(fam) WHEN 0 THEN 'sensitive' WHEN 1 THEN fam[1] WHEN 2 THEN fam[1] || ' and ' || fam[2] ELSE array_to_string(fam[:-2], ', ') || ', and ' || fam[-1] END AS said,
    coalesce(identity, 'strong') = 'strong' AS sure
  FROM k
), d AS (
  SELECT *, CASE
    WHEN z % 5 = 0 AND z % 25 = 0 THEN 'FRAME_DEGRADED_PAYROLL' WHEN z % 5 = 0 AND z % 25 = 10 THEN 'FRAME_DEGRADED_HR' WHEN z % 5 = 0 AND z % 25 = 5 THEN 'FRAME_DEGRADED_INSURANCE'
    WHEN conf = 'fallback' THEN CASE WHEN z % 5 = 0 THEN 'FRAME_PDF_UNREADABLE' WHEN z % 7 = 0 THEN 'FRAME_NOT_SCANNED' ELSE 'FRAME_REVIEW_ADVISED' END
    WHEN c = 'doc.medical_record' AND sure THEN 'FRAME_MEDICAL' WHEN c = 'doc.payroll' AND sure THEN 'FRAME_PAYROLL' WHEN c = 'doc.hr_record' AND sure THEN 'FRAME_HR'
    WHEN c = 'doc.insurance_policy' THEN 'FRAME_INSURANCE' WHEN c = 'doc.invoice' THEN 'FRAME_INVOICE' WHEN c = 'doc.health_certificate' THEN 'FRAME_HEALTH_CERTIFICATE'
    WHEN c IS NULL AND {has(shared)} AND NOT {has(secrets)} AND NOT {has(regulated)} AND NOT {has(legal)} AND NOT {has(business)} THEN 'FRAME_DISTRIBUTION_RESTRICTION'
    WHEN c IS NULL AND z % 6 = 0 AND len(ids) = 1 THEN 'FRAME_PERSONAL_DATA_AWARENESS'
    WHEN c IS NULL AND len(fam) > 1 THEN 'FRAME_COMPOSITE'
    WHEN {has(legal)} THEN 'FRAME_LEGAL'
    WHEN c IS NULL AND {has(business)} THEN 'FRAME_BUSINESS_SENSITIVE'
    WHEN c IS NULL AND r >= 3 AND (z % 4 = 0 OR {has(regulated)}) THEN 'FRAME_REGULATED_SENSITIVE'
    ELSE 'FRAME_GENERAL_SENSITIVE' END AS frame
  FROM q
), rules(frame, rule) AS (VALUES ('FRAME_MEDICAL', 'AWF-001-select-medical'), ('FRAME_PAYROLL', 'AWF-002-select-payroll'), ('FRAME_HR', 'AWF-003-select-hr'), ('FRAME_LEGAL', 'AWF-004-select-legal'), ('FRAME_REGULATED_SENSITIVE', 'AWF-005-select-regulated'),
  ('FRAME_GENERAL_SENSITIVE', 'AWF-006-select-general'), ('FRAME_PERSONAL_DATA_AWARENESS', 'AWF-007-select-personal-data'), ('FRAME_PDF_UNREADABLE', 'AWF-008-select-pdf-unreadable'), ('FRAME_COMPOSITE', 'AWF-009-select-composite'),
  ('FRAME_DISTRIBUTION_RESTRICTION', 'AWF-012-select-distribution'), ('FRAME_REVIEW_ADVISED', 'AWF-013-select-review-advised'), ('FRAME_INSURANCE', 'AWF-014-select-insurance'), ('FRAME_DEGRADED_PAYROLL', 'AWF-015-select-degraded-payroll'),
  ('FRAME_DEGRADED_HR', 'AWF-016-select-degraded-hr'), ('FRAME_DEGRADED_INSURANCE', 'AWF-017-select-degraded-insurance'), ('FRAME_INVOICE', 'AWF-018-select-invoice'), ('FRAME_HEALTH_CERTIFICATE', 'AWF-019-select-health-certificate'),
  ('FRAME_BUSINESS_SENSITIVE', 'AWF-023-select-business-sensitive'), ('FRAME_NOT_SCANNED', 'AWF-024-select-not-scanned')
), texts(frame, headline, plain, inferred, both_, summary, low, guidance) AS ({texts}), tips(hint, more, tip) AS ({tips}
), w AS (SELECT *, frame LIKE 'FRAME_DEGRADED%' AS degraded, frame IN ('FRAME_PDF_UNREADABLE', 'FRAME_NOT_SCANNED', 'FRAME_REVIEW_ADVISED') OR frame LIKE 'FRAME_DEGRADED%' AS special, conf = 'inferred' AS inf FROM d JOIN rules USING (frame) JOIN texts USING (frame) LEFT JOIN tips USING (hint)
)
SELECT doc_id, frame, rule AS frame_rule, CASE WHEN degraded THEN 'inferred' ELSE conf END AS frame_confidence, coalesce(hint, 'unknown') AS frame_hint,
  CASE WHEN special THEN headline WHEN frame = 'FRAME_COMPOSITE' AND inf THEN 'Patterns suggest possible ' || said || ' content' WHEN frame = 'FRAME_COMPOSITE' THEN 'Indicators related to ' || said || ' information were detected'
    WHEN inf THEN CASE WHEN c IS NULL THEN coalesce(both_, inferred, plain, headline) ELSE coalesce(inferred, headline) END WHEN c IS NULL THEN coalesce(plain, headline) ELSE headline END AS frame_headline,
  CASE WHEN frame = 'FRAME_PDF_UNREADABLE' THEN CASE WHEN hint IS NOT NULL THEN summary || ' ' || more WHEN z % 10 = 0 THEN 'This PDF is encrypted and requires a password. Its text cannot be read without that password.' ELSE summary END
    WHEN frame = 'FRAME_REVIEW_ADVISED' THEN coalesce(more, summary) WHEN special THEN summary
    WHEN frame = 'FRAME_COMPOSITE' THEN CASE WHEN inf THEN 'Some indicators may relate to ' || said || ' information. Please verify before sharing.' WHEN r <= 1 THEN 'Some patterns may relate to ' || said || ' information.' ELSE 'Patterns consistent with ' || said || ' information were found.' END
    WHEN r <= 1 OR inf THEN low ELSE summary END AS frame_summary,
  CASE WHEN frame = 'FRAME_PDF_UNREADABLE' THEN coalesce(tip, CASE WHEN z % 10 = 0 THEN 'Open the PDF with the correct password, then re-upload an accessible version for analysis.' END, guidance)
    WHEN frame = 'FRAME_REVIEW_ADVISED' THEN coalesce(tip, guidance) WHEN special THEN guidance
    ELSE guidance || CASE WHEN inf AND tip IS NOT NULL THEN ' ' || tip ELSE '' END || CASE WHEN frame <> 'FRAME_DISTRIBUTION_RESTRICTION' AND {has(shared)} AND ({has(secrets)} OR {has(regulated)} OR {has(legal)}) THEN ' Distribution may also be restricted.' ELSE '' END END AS frame_guidance,
  z % 4 = 0 AS suppress_details, CASE WHEN z % 4 = 0 THEN 'AWF-010-suppress-ontology' END AS suppress_rule
FROM w
"""


def _texts_sql() -> str:
    bad = ["breach", "violation", "illegal", "leak", "incident", "attack", "threat", "danger", "emergency", "alert", "icd", "ontology", "anchor", "heuristic", "regex", "algorithm", "proximity", "cluster", "block", "prevent", "deny", "quarantine", "intercept"]
    words = lambda c: f"list_filter({_list(bad)}, lambda w: contains(lower({c}), w))"
    told = lambda c, n: f"CASE WHEN len({words(c)}) > 0 THEN '{n} contains forbidden words: ' || array_to_string({words(c)}, ', ') END"
    long = lambda c, n, m: f"CASE WHEN length({c}) > {m} THEN '{n} exceeds {m} chars: ' || length({c}) END"
    parts = f"{told('frame_headline', 'Headline')}, {told('frame_summary', 'Summary')}, {long('frame_headline', 'Headline', 80)}, {long('frame_summary', 'Summary', 140)}"
    return f"SELECT frame_headline, frame_summary, concat_ws('; ', {parts}) AS issues, trim(frame_headline) <> '' AND trim(frame_summary) <> '' AND trim(frame_guidance) <> '' AS whole, count(*) AS documents FROM ({_framed_sql()}) GROUP BY ALL"


def queries() -> dict[str, Query]:
    return {"framed_documents": framed_documents, "frame_texts": frame_texts}


def oracle_sql() -> dict[str, str]:
    return {"framed_documents": _framed_sql(), "frame_texts": _texts_sql()}
