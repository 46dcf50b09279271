"""Classes of documents by words, marks and signals: scores, class, baseline, noise and corroborated identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prefilter
from ..functions.patterns import java_regex
from ..plans import class_words as words
from . import archetypes as arch
from .severity import level, rank

# Signals that count for a class, three points (primary) or one (supporting) each.
PRIMARY = {
    "payroll": ["pii.compensation", "hr-compensation", "registry-hr-employee", "nordic-payroll-terms"],
    "hr": ["hr-performance", "hr-compensation", "registry-hr-employee", "hr.employee_data"],
    "insurance": ["global-insurance-terms", "global-insurance-policy-number"],
    "medical": ["hr-medical", "registry-icd10-code", "registry-medical-content", "registry-dk-cpr", "COA-001-icd-standalone", "COA-002-unit-cluster", "COA-003-unit-range-proximity"],
}
SUPPORTING = {
    "payroll": ["pii.employee", "pii.ssn_us", "pii.national_id", "financial.banking", "registry-banking-terms"],
    "hr": ["pii.name", "pii.email", "pii.phone", "legal.agreement", "legal.contract"],
    "insurance": ["global-dob", "global-national-id", "pii.name", "pii.address"],
    "medical": ["global-national-id", "pii.ssn_us", "pii.national_id", "pii.name", "registry-se-personnummer"],
}
# Signals that point to a patient.
PATIENT_IDS = ["global-national-id", "registry-dk-cpr", "registry-se-personnummer", "registry-no-fnr", "registry-fi-hetu", "pii.ssn_us", "pii.national_id", "pii.name", "hr-medical"]
# Signals that corroborate a class.
CORROBORATING = {
    "doc.medical_record": ["global-national-id", "registry-dk-cpr", "registry-se-personnummer", "registry-no-fnr", "registry-fi-hetu", "pii.ssn_us", "pii.national_id", "pii.name", "COA-001-icd-standalone", "COA-002-unit-cluster", "COA-003-unit-range-proximity"],
    "doc.legal_contract": ["structure.clause_numbering", "structure.signature_block", "structure.party_pattern", "structure.esignature", "legal.nda", "pii.name"],
    "doc.hr_record": ["global-national-id", "pii.compensation", "hr-compensation", "english-hr-compensation", "english-hr-performance", "registry-hr-employee", "pii.ssn_us", "pii.national_id", "pii.employee", "pii.name", "financial.banking", "english-financial-banking", "registry-banking-terms"],
    "doc.payroll": ["global-national-id", "pii.compensation", "hr-compensation", "english-hr-compensation", "registry-hr-employee", "pii.ssn_us", "pii.national_id", "pii.employee", "pii.name", "financial.banking", "english-financial-banking", "registry-banking-terms"],
    "doc.insurance_policy": ["global-national-id", "global-dob", "pii.name", "pii.address", "pii.ssn_us", "pii.national_id", "global-insurance-terms", "global-insurance-policy-number"],
    "doc.invoice": ["global-national-id", "pii.name", "pii.address", "financial.banking", "registry-banking-terms", "global-iban"],
    "doc.health_certificate": ["global-national-id", "registry-dk-cpr", "registry-se-personnummer", "registry-no-fnr", "registry-fi-hetu", "pii.name", "global-dob"],
}
# Of each class, the least severity, and labels with and without a corroborated identity.
BASELINES = {"doc.payroll": "high", "doc.hr_record": "high", "doc.medical_record": "critical", "doc.legal_contract": "medium", "doc.insurance_policy": "high", "doc.invoice": "low", "doc.health_certificate": "high"}
LABELS = {
    "doc.payroll": ("Payroll document", "Payroll/compensation terminology"),
    "doc.hr_record": ("HR/Employment record", "HR/employment terminology"),
    "doc.medical_record": ("Medical record", "Medical/clinical terminology"),
    "doc.legal_contract": ("Legal/Contract document", "Legal/contract terminology"),
    "doc.insurance_policy": ("Insurance policy", "Insurance/policy terminology"),
    "doc.invoice": ("Invoice/Receipt", "Invoice/receipt terminology"),
    "doc.health_certificate": ("Health certificate", "Health/vaccination terminology"),
}
# Signals that are noise in tickets, in resumes, and in classed documents.
TICKET_NOISE = ["financial.banking", "financial.iban", "global-iban", "registry-banking-terms", "financial.swift", "global-swift"]
RESUME_NOISE = ["global-ma-terms", "global-ma-valuation-context"]
CARD_NOISE = ["registry-credit-card-spaced", "financial.credit_card", "pii.credit_card"]
URL_NOISE = ["secret.url_with_credentials", "secret.embedded_credentials"]
SWIFT_NOISE = ["financial.swift", "registry-banking-terms"]


MARKERS = (
    "payroll_words", "hr_words", "insurance_words", "medical_words", "name_words", "invoice_points", "certificate_points", "structure_points", "patient_words", "ticket", "resume", "transfer",
)


Patterns = list[tuple[str, str]]
prefilter.register(p for name, known in vars(words).items() if name.isupper() for p, _ in known)


def hits(text: Column, patterns: Patterns, guarded: bool = False) -> Column:
    """How many of the expressions a text holds; guarded ones ask the columns of ``prefilter.facts`` first."""
    if guarded:
        return F.size(F.filter(F.array(*[prefilter.holds(text, p, f) for p, f in patterns]), lambda h: h))
    return reduce(lambda a, b: a + b, [prefilter.holds(text, p, f, False).cast("int") for p, f in patterns])


def holds(text: Column, patterns: Patterns, guarded: bool = False) -> Column:
    """Whether a text holds any of them: one expression for each set of flags."""
    if guarded:
        return F.exists(F.array(*[prefilter.holds(text, p, f) for p, f in patterns]), lambda h: h)
    out = F.lit(False)
    for flags in sorted({f for _, f in patterns}):
        out = out | text.rlike("|".join(f"(?:{java_regex(p, flags)})" for p, f in patterns if f == flags))
    return out


def keyword_count(text: Column, strong: Patterns, plain: Patterns, guarded: bool = False) -> Column:
    """3 where a strong word is there, else the number of plain ones; from 2 on the words count for the class."""
    count = hits(text, plain, guarded)
    return F.when(holds(text, strong, guarded), 3).otherwise(count) if strong else count


def points(text: Column, strong: Patterns, weak: Patterns, guarded: bool = False) -> Column:
    """Three points a strong mark, one a weak one; 0 without a strong mark or in texts under 50 characters."""
    most = hits(text, strong, guarded)
    return F.when((F.length(text) >= 50) & (most > 0), 3 * most + hits(text, weak, guarded)).otherwise(0)


def structure_points(text: Column, filename: Column, guarded: bool = False) -> Column:
    """Points for the structure of a contract: numbered clauses, signatures, parties, the file's name."""
    each = [F.regexp_extract_all(text, F.lit(java_regex(p, f)), F.lit(0)) for p, f in words.CLAUSES]
    if guarded:
        each = [F.when(prefilter.may_match(text, p, f), e).otherwise(F.array().cast("array<string>")) for e, (p, f) in zip(each, words.CLAUSES, strict=True)]
    numbers = F.array_distinct(F.flatten(F.array(*each)))
    clauses, signed, parties = F.size(numbers), hits(text, words.SIGNATURES, guarded), hits(text, words.PARTIES, guarded)
    name = F.translate(F.lower(F.coalesce(filename, F.lit(""))), "_", " ")
    # an array of one: each count is compared several times and made once
    counted = lambda n, score: F.element_at(F.transform(F.array(n), score), 1)
    total = (
        counted(clauses, lambda n: F.when(n >= 10, 4).when(n >= 6, 3).when(n >= 3, 1).otherwise(0))
        + counted(signed, lambda n: F.when(n >= 2, 3).when(n == 1, 1).otherwise(0))
        + F.when(holds(text, words.E_SIGNATURES, guarded), 2).otherwise(0)
        + F.when(name.rlike("contract|kontrakt|avtale|aftale|agreement|vertrag"), 2).otherwise(0)
        + F.when(name.rlike("docusign|hellosign|adobesign|pandadoc"), 2).otherwise(0)
        + counted(parties, lambda n: F.when(n >= 2, 2).when(n == 1, 1).otherwise(0))
    )
    return F.when(F.length(text) >= 200, total).otherwise(0)


def markers(docs: DataFrame, text_col: str = "text", filename_col: str | None = None, guarded: bool = False) -> DataFrame:
    """Adds what the words of a text and its file's name say: counts, points and contexts. Narrow.

    payroll_words, hr_words, insurance_words, medical_words, name_words, invoice_points,
    certificate_points, structure_points, patient_words, ticket, resume, transfer. Null texts and
    names count as empty. ``guarded``: ``docs`` has the columns of ``prefilter.facts`` of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(filename_col), F.lit("")) if filename_col else F.lit("")
    plain, bare = F.translate(text, "_", " "), F.translate(name, "_", " ")
    return docs.withColumns({
        "payroll_words": keyword_count(text, words.STRONG_PAYROLL, words.PAYROLL, guarded),
        "hr_words": keyword_count(text, words.STRONG_HR, words.HR, guarded),
        "insurance_words": keyword_count(text, [], words.INSURANCE, guarded),
        "medical_words": keyword_count(plain, words.STRONG_MEDICAL, words.MEDICAL, guarded),  # blanks for underscores change no fact
        "name_words": keyword_count(bare, words.STRONG_MEDICAL, words.MEDICAL) if filename_col else F.lit(0),
        "invoice_points": points(text, words.INVOICE_STRONG, words.INVOICE_WEAK, guarded),
        "certificate_points": points(text, words.CERTIFICATE_STRONG, words.CERTIFICATE_WEAK, guarded),
        "structure_points": structure_points(text, name, guarded),
        "patient_words": holds(text, words.PATIENT, guarded) | (holds(bare, words.PATIENT) if filename_col else F.lit(False)),
        "ticket": (F.length(text) >= 50) & (hits(text, words.TICKET, guarded) >= 2),
        "resume": (F.length(text) >= 100) & (hits(text, words.RESUME, guarded) >= 2),
        "transfer": (F.length(text) >= 20) & holds(text, words.TRANSFER, guarded),
    })


def _of(ids: Column, known: list[str]) -> Column:
    return F.size(F.array_intersect(ids, F.array(*[F.lit(k) for k in known])))


def patient_context(ids: Column) -> Column:
    return (_of(ids, PATIENT_IDS) > 0) | F.col("patient_words")


def document_class(ids: Column, clinical: Column | None = None) -> Column:
    """The class by ``markers`` and the ids of the document's signals, or null.

    ``clinical`` is how many clinical structures the text has. Medical records need a patient; then
    payroll or employment by score (employment on a tie), insurance, invoice, certificate, contract.
    """
    more = {"payroll": F.lit(0), "hr": F.lit(0), "insurance": F.lit(0), "medical": F.col("name_words").between(2, 99).cast("int") + (F.lit(0) if clinical is None else clinical)}
    primary, score = {}, {}
    for name in PRIMARY:
        count = F.col(f"{name}_words")
        primary[name] = _of(ids, PRIMARY[name]) + (count >= 2).cast("int") + more[name]
        score[name] = 3 * primary[name] + _of(ids, SUPPORTING[name]) + (count > 2).cast("int")
    payroll, hr = primary["payroll"] > 0, primary["hr"] > 0
    return (
        F.when((primary["medical"] > 0) & patient_context(ids), "doc.medical_record")
        .when(hr & (~payroll | (score["hr"] >= score["payroll"])), "doc.hr_record")
        .when(payroll, "doc.payroll")
        .when(primary["insurance"] > 0, "doc.insurance_policy")
        .when(F.col("invoice_points") >= 4, "doc.invoice")
        .when(F.col("certificate_points") >= 4, "doc.health_certificate")
        .when(F.col("structure_points") >= 5, "doc.legal_contract")
    )


def _by_class(cls: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), cls)


def baseline(cls: Column) -> Column:
    return F.when(cls.isNotNull(), _by_class(cls, BASELINES))


def with_floor(severity: Column, cls: Column) -> Column:
    """At least the baseline of the class."""
    return F.when(cls.isNull(), severity).otherwise(level(F.greatest(rank(severity), rank(baseline(cls)))))


def identity_confidence(ids: Column, cls: Column, patient: Column) -> Column:
    """none without a class, strong where the class is corroborated, else weak."""
    count = F.lit(0)
    for name, known in CORROBORATING.items():
        count = F.when(cls == name, _of(ids, known)).otherwise(count)
    pays = _of(ids, ["pii.compensation", "hr-compensation"]) > 0
    strong = (
        F.when(cls == "doc.medical_record", patient | (count >= 2))
        .when(cls.isin("doc.hr_record", "doc.payroll"), pays | (count >= 2))
        .when(cls == "doc.insurance_policy", F.array_contains(ids, "global-insurance-policy-number") | (count >= 2))
        .when(cls == "doc.legal_contract", count >= 2)
        .otherwise(count >= 1)
    )
    return F.when(cls.isNull(), "none").when(strong, "strong").otherwise("weak")


def label(cls: Column, identity: Column) -> Column:
    """The class's name where its identity is strong, else its terminology only."""
    return F.when(identity == "strong", _by_class(cls, {k: v[0] for k, v in LABELS.items()})).otherwise(_by_class(cls, {k: v[1] for k, v in LABELS.items()}))


def noise(ids: Column, cls: Column, card_holder: Column) -> Column:
    """The ids that are noise: in tickets, else in resumes, where no class was found, or in a classed document.

    Cards are noise without an anchor (CVV, expiry, holder), addresses with credentials in payroll and
    employment, banking words without a person. An IBAN in a ticket counts when money is to be transferred.
    """
    has = lambda part: F.exists(ids, lambda i: F.contains(i, F.lit(part)))
    keep = lambda known: F.array_intersect(ids, F.array(*[F.lit(k) for k in known]))
    none = F.array().cast("array<string>")
    ticket = F.when(F.col("transfer"), keep([k for k in TICKET_NOISE if not k.endswith("iban")])).otherwise(keep(TICKET_NOISE))
    anchored = has("cvv") | has("expiry") | has("cardholder") | card_holder
    person = has("pii.") | has("employee") | has("name")
    classed = F.concat(
        F.when(anchored, none).otherwise(keep(CARD_NOISE)),
        F.when(cls.isin("doc.payroll", "doc.hr_record"), keep(URL_NOISE)).otherwise(none),
        F.when(person, none).otherwise(keep(SWIFT_NOISE)),
    )
    return F.array_sort(F.when(cls.isNotNull(), classed).when(F.col("ticket"), ticket).when(F.col("resume"), keep(RESUME_NOISE)).otherwise(none))


def classified(out: DataFrame, ids: Column, clinical: Column | None = None, card_holder: Column | None = None, archetypes: Column | None = None, structures: Column | None = None) -> DataFrame:
    """``anchored`` for rows that have the columns of ``markers`` already.

    ``archetypes`` (of ``archetypes.detect``) silence generic keywords for the class and rule classes out.
    ``structures`` are ids of clinical structures; they corroborate a medical record.
    """
    said = ids if archetypes is None else arch.without_generic(ids, archetypes)
    cls = document_class(said, clinical)
    out = out.withColumn("document_class", cls if archetypes is None else arch.vetoed_class(cls, archetypes)).withColumn("patient_context", patient_context(ids))
    cls = F.col("document_class")
    out = out.withColumn("identity_confidence", identity_confidence(said if structures is None else F.concat(said, structures), cls, F.col("patient_context")))
    held = F.lit(False) if card_holder is None else card_holder
    silenced = noise(said, cls, held) if archetypes is None else F.concat(noise(said, cls, held), F.array_except(ids, said))
    return out.withColumns({"baseline": baseline(cls), "class_label": F.when(cls.isNotNull(), label(cls, F.col("identity_confidence"))), "noise_ids": F.array_sort(F.array_distinct(silenced))})


def anchored(docs: DataFrame, ids_col: str = "ids", text_col: str = "text", filename_col: str | None = None, clinical: Column | None = None, card_holder: Column | None = None) -> DataFrame:
    """Adds document_class, baseline, patient_context, identity_confidence, class_label and noise_ids.

    ``ids_col`` holds the ids of a document's signals; null stands for none, null ids in it are ignored.
    ``clinical`` counts clinical structures, ``card_holder`` tells whether a description names one.
    """
    ids = F.array_distinct(F.array_compact(F.coalesce(F.col(ids_col), F.array().cast("array<string>"))))
    facts = prefilter.facts(F.coalesce(F.col(text_col), F.lit("")))
    return classified(markers(docs.withColumns(facts), text_col, filename_col, guarded=True), ids, clinical, card_holder).drop(*facts)
