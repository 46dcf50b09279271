"""Which frame a decision is told in, and its headline, summary and guidance.

A frame is chosen by a decision table: conditions over the facts of a document in order of priority,
the first that holds counts. Its texts are templates whose named places are filled from a map. All of
it is one projection over the facts; nothing is joined and nothing leaves the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import found, strings
from . import framing

# Frames (id, headline, headline without a class, headline where inferred, both, summary, summary of low severity, guidance).
_REVIEW = "Review before sharing externally."
_LIMITED = "Consider this sensitive and review before sharing. This PDF could not be fully analyzed."
FRAMES: list[tuple[str, str, str | None, str | None, str | None, str, str, str]] = [
    ("FRAME_MEDICAL", "This file contains medical or health information", "Indicators that may relate to health information were found", "Patterns suggest possible medical content", "This may include health information",
     "Some patterns are consistent with health records or clinical data.", "A few patterns may relate to health information.", _REVIEW),
    ("FRAME_PAYROLL", "This file contains financial or payroll data", "Indicators that may relate to financial information were found", "Patterns suggest possible payroll or compensation content", "This may include financial information",
     "Some patterns are consistent with salary or payment details.", "A few patterns may relate to payment information.", _REVIEW),
    ("FRAME_HR", "This file contains employee or HR records", "Indicators that may relate to employment information were found", "Patterns suggest possible HR or employment content", "This may include employment information",
     "Some patterns are consistent with employee records.", "A few patterns may relate to employee information.", _REVIEW),
    ("FRAME_LEGAL", "This file contains legal agreement language", "Indicators related to legal language were found", "Patterns suggest possible legal content", "This may include legal terminology",
     "Some patterns are consistent with contracts or agreements.", "A few patterns may relate to legal terminology.", _REVIEW),
    ("FRAME_REGULATED_SENSITIVE", "This file contains a government-issued identifier", "This file may contain a government-issued identifier", "This file appears to contain a government-issued identifier", "This file may contain regulated personal information",
     "Some patterns may be subject to privacy or compliance rules.", "A few patterns may relate to regulated data.", _REVIEW),
    ("FRAME_PERSONAL_DATA_AWARENESS", "This file contains personal contact information", "Indicators that may relate to individuals were found", "Patterns suggest information that could identify a person", "This may include identifiable information",
     "Some patterns may relate to an identifiable individual.", "A few patterns may relate to personal details.", _REVIEW),
    ("FRAME_GENERAL_SENSITIVE", "Sensitive content was detected", "Sensitive content was detected", "This may include sensitive content", "This may include sensitive content",
     "Some patterns may be private or confidential.", "A few patterns may relate to personal information.", _REVIEW),
    ("FRAME_PDF_UNREADABLE", "This file could not be fully analyzed", None, None, None,
     "This file's structure limited what could be read locally. The AI tool may extract more than we could analyze.", "Some content in this file may not have been fully analyzed locally.", "Review the file for sensitive information before proceeding."),
    ("FRAME_INSURANCE", "This file contains insurance policy information", "This file may contain insurance-related information", "This file appears to contain insurance or policy content", "This file may relate to insurance information",
     "Some patterns are consistent with insurance policy details.", "A few patterns may relate to insurance information.", "Insurance documents often contain personal details. Review before sharing externally."),
    ("FRAME_COMPOSITE", "This file contains multiple types of sensitive information", None, "This file may contain multiple types of sensitive information", None,
     "Indicators related to {familyList} were found.", "Some patterns may relate to {familyList}.", _REVIEW),
    ("FRAME_DISTRIBUTION_RESTRICTION", "This file has internal sharing restrictions", None, None, None,
     "Language commonly used to limit redistribution was found.", "Some markers may indicate distribution limits.", _REVIEW),
    ("FRAME_DEGRADED_PAYROLL", "This file may contain payroll information", None, None, None,
     "The filename or metadata suggests this may contain salary or payment information. Text extraction was limited.", "The filename or metadata suggests this may relate to payroll. Full content could not be verified.", _LIMITED),
    ("FRAME_DEGRADED_HR", "This file may contain employment information", None, None, None,
     "The filename or metadata suggests this may contain HR or employment information. Text extraction was limited.", "The filename or metadata suggests this may relate to employment. Full content could not be verified.", _LIMITED),
    ("FRAME_DEGRADED_INSURANCE", "This file may contain insurance information", None, None, None,
     "The filename or metadata suggests this may contain insurance policy information. Text extraction was limited.", "The filename or metadata suggests this may relate to insurance. Full content could not be verified.", _LIMITED),
    ("FRAME_INVOICE", "This file appears to be an invoice or receipt", "Indicators related to invoices were found", "Patterns suggest possible invoice content", "This may include billing or invoices",
     "This document contains billing or payment information that may include personal or financial details.", "A few patterns may relate to billing or invoice information.", _REVIEW),
    ("FRAME_HEALTH_CERTIFICATE", "This file appears to be a health certificate", "Indicators related to health records were found", "Patterns suggest possible health or vaccination content", "This may include health documentation",
     "This document contains health-related information that may include personal identifiers.", "A few patterns may relate to health documentation.", "Health documents typically contain sensitive personal data. Review before sharing."),
    ("FRAME_BUSINESS_SENSITIVE", "This file may contain commercially sensitive information", "Indicators related to business-sensitive content were found", "Patterns suggest possible commercially sensitive content", "This may include business-sensitive information",
     "Some patterns are consistent with business-sensitive or transaction-related content.", "This may include commercially sensitive or transaction-related material.", "Business-sensitive documents may contain material non-public information. Review before sharing externally."),
    ("FRAME_REVIEW_ADVISED", "We couldn’t determine what this file contains", None, None, None,
     "No obvious sensitive-data markers were found — but that isn’t a guarantee. Review before sharing if unsure.", "No specific indicators were found. Review if you believe it may contain personal details.", "Use your judgment based on what you know about this document."),
    ("FRAME_NOT_SCANNED", "This file could not be fully checked", None, None, None,  # the product's name is left out
     "This file was not fully analyzed locally, so its contents could not be confirmed before sharing.", "Some of this file may not have been analyzed locally before sharing.", "Review it yourself before sharing if it may contain personal or confidential details."),
]

# Parts of signals' ids.
REGULATED = ["coa-", "icd", "clinical", "registry-", "pii.", "financial."]
DISTRIBUTION = ["global-confidential-en", "global-confidential-de", "global-confidential-fr", "global-confidential-es", "global-confidential-nordic", "english-gov-clearance", "romance-confidential", "nordic-confidential"]
SECRETS = ["global-api-key", "global-bearer-token", "global-aws-access-key", "global-password", "global-private-key", "global-connection-string", "global-url-credentials", "global-ma-terms"]
BUSINESS = ["global-ma-terms", "global-ma-valuation", "global-financial-report"]
LEGAL = ["legal.", "contract", "nda", "agreement", "privileged"]
CLASS_DRIVERS = ["doc.payroll", "doc.hr_record", "doc.medical_record"]

# What a file's name hints at (hint, parts of the name, addition to the summary, addition to the guidance), the first counts.
HINTS = [
    ("contract_like", ["contract", "nda", "agreement", "docusign", "signatur", "terms"], "The filename suggests this may be a contract or agreement.",
     "Contracts often contain terms that should be reviewed before external sharing, even without explicit markers."),
    ("hr_like", ["resign", "employment", "onboard", "offer letter", "termination", "medarbejder", "ansættel"], "The filename suggests this may relate to HR or employment.",
     "HR documents are often sensitive by nature, even without explicit personal data markers."),
    ("financial_like", ["invoice", "payroll", "salary", "løn", "faktura"], "The filename suggests this may relate to financial matters.",
     "Financial documents often contain information that should be handled carefully."),
    ("medical_like", ["medical", "health", "patient", "diagnos", "sundhed", "labsvar", "journal"], "The filename suggests this may relate to health or medical information.",
     "Medical documents typically require careful handling regardless of detected content."),
    ("insurance_like", ["insurance", "forsikring", "police", "claim"], "The filename suggests this may be an insurance document.",
     "Insurance documents often contain personal details that warrant review before sharing."),
    ("public_like", ["whitepaper", "guide", "manual", "handbook", "operating model", "operating-model", "operating_model", "readme", "overview"], "This appears to be informational or educational material.",
     "Verify this is intended for external audiences before sharing."),
]

# Words no text for users may hold, and the most characters of a headline and a summary.
FORBIDDEN = ["breach", "violation", "illegal", "leak", "incident", "attack", "threat", "danger", "emergency", "alert", "icd", "ontology", "anchor", "heuristic", "regex", "algorithm", "proximity", "cluster", "block", "prevent", "deny", "quarantine", "intercept"]
MOST_HEADLINE, MOST_SUMMARY = 80, 140
# Headlines that imply a kind of document, and the one that takes their place without a class.
CATEGORY_HEADLINES = [r"\bmedical[- ]?related\b", r"\blegal[- ]?related\b", r"\bhr[- ]?related\b", r"\bfinancial[- ]?related\b", r"\bmedical record\b", r"\blegal document\b", r"\bhr document\b", r"\bfinancial document\b"]
SAFE_HEADLINE = "Indicators that may warrant review were found"
PASSWORD_SUMMARY = "This PDF is encrypted and requires a password. Its text cannot be read without that password."  # the product's name is left out
PASSWORD_GUIDANCE = "Open the PDF with the correct password, then re-upload an accessible version for analysis."
DISTRIBUTION_NOTE = "Distribution may also be restricted."
COMPOSITE = {
    "headline": "Indicators related to {familyList} were detected", "summary": "Patterns consistent with {familyList} were found.", "low": "Some patterns may relate to {familyList}.",
    "inferred_headline": "Patterns suggest possible {families} content", "inferred_summary": "Some indicators may relate to {familyList}. Please verify before sharing.",
}


def _any(ids: Column, parts: list[str]) -> Column:
    """Whether some id holds some part, in lower case."""
    return F.exists(ids, lambda i: F.exists(strings(parts), lambda p: F.contains(F.lower(i), p)))


def fill(template: Column, values: Column) -> Column:
    """A template with its named places filled: a fold over the map's entries; names the map lacks stay."""
    return F.aggregate(F.map_entries(values), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def only_distribution(ids: Column) -> Column:
    """Marks of how to share, and nothing that says what a document holds."""
    return _any(ids, DISTRIBUTION) & ~_any(ids, SECRETS) & ~_any(ids, REGULATED) & ~_any(ids, LEGAL) & ~_any(ids, BUSINESS)


def distribution_and_content(ids: Column) -> Column:
    return _any(ids, DISTRIBUTION) & (_any(ids, SECRETS) | _any(ids, REGULATED) | _any(ids, LEGAL))


def name_hint(filename: Column) -> Column:
    """What a file's name hints at; null where nothing."""
    lower, out = F.lower(filename), F.lit(None).cast("string")
    for hint, parts, *_ in reversed(HINTS):
        out = F.when(framing._has_any(lower, parts), hint).otherwise(out)
    return out


def _of_hint(hint: Column, place: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for h in HINTS for x in (h[0], h[place])]), hint)


def _of_frame(frame: Column, place: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x).cast("string") for f in FRAMES for x in (f[0], f[place])]), frame)


def decision_table(f: dict[str, Column]) -> list[tuple[str, str, Column]]:
    """Rules in order of priority: rule id, frame, condition over facts."""
    c, ids, fallback = f["document_class"], f["driving_ids"], f["confidence"] == "fallback"
    strong = F.coalesce(f["identity_confidence"] == "strong", F.lit(True))
    plain = c.isNull()
    is_class = lambda name: F.coalesce(c == name, F.lit(False))
    degraded = lambda name: f["pdf_failed"] & F.coalesce(f["degraded_domain"] == name, F.lit(False))
    return [
        ("AWF-015-select-degraded-payroll", "FRAME_DEGRADED_PAYROLL", degraded("payroll")),
        ("AWF-016-select-degraded-hr", "FRAME_DEGRADED_HR", degraded("hr_contract")),
        ("AWF-017-select-degraded-insurance", "FRAME_DEGRADED_INSURANCE", degraded("insurance")),
        ("AWF-008-select-pdf-unreadable", "FRAME_PDF_UNREADABLE", f["pdf_failed"] & fallback),
        ("AWF-024-select-not-scanned", "FRAME_NOT_SCANNED", f["not_scanned"] & fallback),
        ("AWF-013-select-review-advised", "FRAME_REVIEW_ADVISED", fallback),
        ("AWF-001-select-medical", "FRAME_MEDICAL", is_class("doc.medical_record") & strong),
        ("AWF-002-select-payroll", "FRAME_PAYROLL", is_class("doc.payroll") & strong),
        ("AWF-003-select-hr", "FRAME_HR", is_class("doc.hr_record") & strong),
        ("AWF-014-select-insurance", "FRAME_INSURANCE", is_class("doc.insurance_policy")),
        ("AWF-018-select-invoice", "FRAME_INVOICE", is_class("doc.invoice")),
        ("AWF-019-select-health-certificate", "FRAME_HEALTH_CERTIFICATE", is_class("doc.health_certificate")),
        ("AWF-012-select-distribution", "FRAME_DISTRIBUTION_RESTRICTION", plain & only_distribution(ids)),
        ("AWF-007-select-personal-data", "FRAME_PERSONAL_DATA_AWARENESS", plain & f["single_strong"]),
        ("AWF-009-select-composite", "FRAME_COMPOSITE", plain & (F.size(f["families"]) > 1)),
        ("AWF-004-select-legal", "FRAME_LEGAL", _any(ids, LEGAL)),
        ("AWF-023-select-business-sensitive", "FRAME_BUSINESS_SENSITIVE", plain & _any(ids, BUSINESS)),
        ("AWF-005-select-regulated", "FRAME_REGULATED_SENSITIVE", plain & f["severity"].isin("high", "critical") & (f["ontology_driven"] | _any(ids, REGULATED))),
        ("AWF-006-select-general", "FRAME_GENERAL_SENSITIVE", F.lit(True)),
    ]


#: Facts and what stands for a missing one: (name, type, default).
FACTS = [
    ("document_class", "string", None), ("severity", "string", "none"), ("ontology_driven", "boolean", False), ("driving_ids", "array<string>", "array()"), ("single_strong", "boolean", False), ("signal_count", "bigint", None),
    ("filename", "string", None), ("identity_confidence", "string", None), ("pdf_failed", "boolean", False), ("password_required", "boolean", False), ("degraded_domain", "string", None), ("not_scanned", "boolean", False),
]


def framed(df: DataFrame) -> DataFrame:
    """``df`` with frame, frame_rule, frame_confidence, frame_hint, frame_headline, frame_summary, frame_guidance, suppress_details, suppress_rule.

    Reads the columns of FACTS; one that is missing or null counts as its default, and a null signal
    count as the number of drivers. The facts' own columns stay as they are.
    """
    facts = {}
    for name, kind, default in FACTS:
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        facts[name] = value if default is None else F.coalesce(value, F.array().cast(kind) if default == "array()" else F.lit(default))
    base = df.select("*", F.struct(*[v.alias(k) for k, v in facts.items()]).alias("__f"))
    f = {k: F.col(f"__f.{k}") for k in facts}
    count = F.coalesce(f["signal_count"], F.size(f["driving_ids"]))
    base = base.withColumns({"__families": framing.families(f["driving_ids"]), "__confidence": framing.surface_confidence(f["document_class"], f["driving_ids"], f["severity"], count), "__hint": name_hint(f["filename"])})
    f |= {"families": F.col("__families"), "confidence": F.col("__confidence")}
    chosen = F.lit(None)
    for rule, frame, condition in reversed(decision_table(f)):
        chosen = F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(frame).alias("frame"))).otherwise(chosen)
    base = base.withColumn("__chosen", chosen)
    rule, frame = F.col("__chosen.rule"), F.col("__chosen.frame")
    special = frame.isin("FRAME_DEGRADED_PAYROLL", "FRAME_DEGRADED_HR", "FRAME_DEGRADED_INSURANCE", "FRAME_PDF_UNREADABLE", "FRAME_NOT_SCANNED", "FRAME_REVIEW_ADVISED")
    inferred, plain = F.col("__confidence") == "inferred", f["document_class"].isNull()
    low = f["severity"].isin("low", "none")
    hint, composite = F.col("__hint"), frame == "FRAME_COMPOSITE"

    headline = F.when(special, _of_frame(frame, 1)).when(composite, F.when(inferred, COMPOSITE["inferred_headline"]).otherwise(COMPOSITE["headline"])).otherwise(
        F.when(inferred, F.coalesce(F.when(plain, _of_frame(frame, 4)), _of_frame(frame, 3), F.when(plain, _of_frame(frame, 2)), _of_frame(frame, 1))).otherwise(F.coalesce(F.when(plain, _of_frame(frame, 2)), _of_frame(frame, 1)))
    )
    unreadable = F.when(hint.isNotNull(), F.concat(_of_frame(frame, 5), F.lit(" "), _of_hint(hint, 2))).when(f["password_required"], PASSWORD_SUMMARY).otherwise(_of_frame(frame, 5))
    summary = (
        F.when(frame == "FRAME_PDF_UNREADABLE", unreadable).when(frame == "FRAME_REVIEW_ADVISED", F.coalesce(_of_hint(hint, 2), _of_frame(frame, 5))).when(special, _of_frame(frame, 5))
        .when(composite, F.when(inferred, COMPOSITE["inferred_summary"]).when(low, COMPOSITE["low"]).otherwise(COMPOSITE["summary"])).when(low | inferred, _of_frame(frame, 6)).otherwise(_of_frame(frame, 5))
    )
    guidance = (
        F.when(frame == "FRAME_PDF_UNREADABLE", F.coalesce(_of_hint(hint, 3), F.when(f["password_required"], PASSWORD_GUIDANCE), _of_frame(frame, 7)))
        .when(frame == "FRAME_REVIEW_ADVISED", F.coalesce(_of_hint(hint, 3), _of_frame(frame, 7))).when(special, _of_frame(frame, 7))
        .otherwise(F.concat_ws(" ", _of_frame(frame, 7), F.when(inferred, _of_hint(hint, 3)), F.when((frame != "FRAME_DISTRIBUTION_RESTRICTION") & distribution_and_content(f["driving_ids"]), DISTRIBUTION_NOTE)))
    )
    words = framing.family_list(F.col("__families"))
    places = F.create_map(F.lit("familyList"), words, F.lit("families"), F.regexp_replace(words, " information$", ""))
    implies = F.lit(False)
    for pattern in CATEGORY_HEADLINES:
        implies = implies | found(headline, pattern, "i")
    spoken = F.when(plain & ~special & implies, SAFE_HEADLINE).otherwise(headline)
    by_class = f["document_class"].isNotNull() & F.arrays_overlap(f["driving_ids"], strings(CLASS_DRIVERS))
    suppress = F.when(f["ontology_driven"], "AWF-010-suppress-ontology").when(by_class, "AWF-011-suppress-doc-class")
    confidence = F.when(frame.startswith("FRAME_DEGRADED"), "inferred").otherwise(F.col("__confidence"))
    return base.select(
        *df.columns, frame.alias("frame"), rule.alias("frame_rule"), confidence.alias("frame_confidence"), F.coalesce(hint, F.lit("unknown")).alias("frame_hint"), fill(spoken, places).alias("frame_headline"), fill(summary, places).alias("frame_summary"),
        guidance.alias("frame_guidance"), suppress.isNotNull().alias("suppress_details"), suppress.alias("suppress_rule"),
    )


def text_issues(headline: Column, summary: Column) -> Column:
    """What is wrong with a frame's texts: forbidden words in either, and texts that are too long."""
    words = lambda t: F.filter(strings(FORBIDDEN), lambda w: F.contains(F.lower(t), w))
    told = lambda t, name: F.when(F.size(words(t)) > 0, F.concat(F.lit(f"{name} contains forbidden words: "), F.array_join(words(t), ", ")))
    long = lambda t, name, most: F.when(F.length(t) > most, F.concat(F.lit(f"{name} exceeds {most} chars: "), F.length(t).cast("string")))
    return F.array_compact(F.array(told(headline, "Headline"), told(summary, "Summary"), long(headline, "Headline", MOST_HEADLINE), long(summary, "Summary", MOST_SUMMARY)))


def complete(df: DataFrame) -> Column:
    """Whether all of a frame's texts are there and not blank."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    return ~(blank("frame") | blank("frame_headline") | blank("frame_summary") | blank("frame_guidance"))
