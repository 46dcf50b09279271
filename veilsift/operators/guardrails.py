"""What is enforced on a decision once it is made: dominance, identity, caps, escalation, visibility, consistency, mapping.

Everything is a column expression over one row a document, with its signals in arrays: nothing moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prefilter
from ..functions.patterns import around, contains_any
from . import calibration, gates
from .severity import level, rank

# Ids of cards, of personnel, contracts, health and persons.
CARD_IDS = ["financial.credit_card", "pii.credit_card", "registry-credit-card-spaced", "registry-credit-card"]
HR_IDS = ["pii.employee", "pii.compensation", "hr-compensation", "hr-performance", "hr-medical", "hr.employee_data", "registry-hr-employee", "doc.payroll", "doc.hr_record"]
LEGAL_IDS = ["legal.contract", "legal.agreement", "legal.nda", "legal.privileged", "doc.legal_contract"]
MEDICAL_IDS = ["doc.medical_record", "hr-medical", "registry-medical-content", "registry-icd10-code", "COA-001-icd-standalone", "COA-002-unit-cluster", "COA-003-unit-range-proximity"]
PII_IDS = ["global-national-id", "pii.ssn", "pii.ssn_us", "pii.national_id", "pii.name", "pii.phone", "pii.email", "pii.address", "registry-dk-cpr", "registry-se-personnummer", "registry-no-fnr", "registry-fi-hetu"]
# What in a text tells of personnel and of contracts, and the form of a Danish personal number.
HR_CONTEXT = [
    r"\bemployment\s*agreement\b", r"\bemployee\s*number\b", r"\bhr\s*service\s*cent(re|er)\b", r"\bpeople\s*services?\b", r"\bcompensation\s*&?\s*benefits\b", r"\bemployment\s*contract\b",
    r"\bsalary\b", r"\bbonus\b", r"\bonnboarding\b", r"\btermination\b", r"\bprobation(ary)?\s*period\b",
]
LEGAL_CONTEXT = [
    r"\bdocusign\s*envelope\s*id\b", r"\bsigned\s*(?:by|on)\b", r"\bcontract(?:ual)?\s*(?:terms?|agreement)\b", r"\bwhereas\b", r"\bhereby\b", r"\bindemnif(?:y|ication)\b", r"\bjurisdiction\b",
    r"\bgoverning\s*law\b", r"\bconfidential(?:ity)?\s*(?:agreement|clause)\b",
]
CPR_FORM = r"\b\d{6}-?\d{4}\b"
prefilter.register([*HR_CONTEXT, *LEGAL_CONTEXT])
# Rules by which signals are put in order.
HR_RULE, MEDICAL_RULE, LEGAL_RULE = "SID-001-hr-context-dominance", "SID-002-medical-context-dominance", "SID-003-legal-context-dominance"
INFERRED_RULES = {"hr": "SID-004-hr-context-inferred", "legal": "SID-005-legal-context-inferred", "pii": "SID-006-pii-context-inferred"}
NO_DOMINANCE, NO_CARDS = "SID-010-no-dominance", "SID-011-no-card-signals"
# Primary and corroborating ids of the domains, and parts of an id that place it in one.
DOMAINS = {
    "medical": (["hr-medical", "registry-icd10-code", "registry-medical-content", "COA-001-icd-standalone", "COA-002-unit-cluster", "COA-003-unit-range-proximity"], ["global-national-id", "registry-dk-cpr", "global-dk-cpr", "registry-se-personnummer", "registry-no-fnr", "registry-fi-hetu", "pii.ssn_us", "pii.national_id", "pii.name"], ["medical", "icd", "coa-", "clinical", "health", "patient"]),
    "legal": (["legal.contract", "legal.nda", "legal.agreement", "legal.privileged", "dictionary.legal"], ["structure.clause_numbering", "structure.signature_block", "structure.party_pattern", "structure.esignature", "pii.name"], ["legal", "contract", "nda", "agreement"]),
    "hr": (["hr.employee_data", "hr-employee", "registry-hr-employee", "pii.employee", "dictionary.hr", "nordic-payroll-terms"], ["global-national-id", "pii.compensation", "hr-compensation", "pii.ssn_us", "pii.national_id", "pii.name", "financial.banking"], ["hr-", "employee", "payroll", "compensation"]),
    "financial": (["financial.iban", "financial.credit_card", "pii.credit_card", "financial.banking", "dictionary.finance"], ["global-national-id", "pii.name", "pii.ssn_us"], ["financial", "banking", "iban", "credit_card"]),
}
CLASS_DOMAINS = {"doc.medical_record": "medical", "doc.legal_contract": "legal", "doc.hr_record": "hr", "doc.payroll": "hr", "doc.insurance_policy": "financial"}
# Labels of ids that name an identity, and of their terminology.
IDENTITY_LABELS = {
    "hr-medical": ("Medical record", "Medical terminology"),
    "registry-medical-content": ("Medical record", "Medical terminology"),
    "COA-001-icd-standalone": ("Medical record", "Clinical codes"),
    "COA-002-unit-cluster": ("Medical record", "Clinical measurements"),
    "COA-003-unit-range-proximity": ("Medical record", "Clinical data"),
    "legal.contract": ("Legal document", "Contract terminology"),
    "legal.nda": ("Legal document", "NDA terminology"),
    "legal.agreement": ("Legal document", "Agreement terminology"),
    "legal.privileged": ("Legal document", "Legal terminology"),
    "hr.employee_data": ("HR record", "HR/Employee patterns"),
    "hr-employee": ("HR record", "HR terminology"),
    "pii.employee": ("HR record", "Employee data patterns"),
}
# Ids that a document's context caps, that nothing caps, and that make the context.
CAPPED_IDS = ["global-national-id", "global-dk-cpr", "global-se-personnummer", "global-no-fnr", "global-fi-hetu", "global-de-steuer-id", "global-nl-bsn", "global-be-nrn", "global-fr-nir", "global-it-codice-fiscale", "global-es-nie", "global-pl-pesel", "global-pt-nif", "global-ro-cnp", "global-cz-rc", "global-sk-rc", "global-hu-taj", "global-br-cpf", "global-mx-rfc", "global-us-ssn", "global-uk-nin"]
UNCAPPED_IDS = ["global-api-key-sk", "global-aws-access-key", "global-bearer-token", "global-private-key", "global-password-assignment", "global-url-query-credentials", "global-ma-terms"]
MEDICAL_CONTEXT = ["registry-medical-content", "registry-icd10-code"]
EMPLOYMENT_CONTEXT = ["registry-hr-employee", "english-hr-compensation", "english-hr-performance", "nordic-payroll-terms"]
INSURANCE_CONTEXT = ["global-insurance-terms", "global-insurance-policy-number"]
BIRTH_IDS, INCIDENTAL_IDS = ["global-dob"], ["global-swift", "nordic-financial-terms", "english-financial-statement"]
# Ids of payment cards, words near one, and the most severe level of each surface confidence.
PAYMENT_IDS = ["pii.credit_card", "financial.credit_card", "financial.payment_card", "registry-credit-card", "registry-credit-card-spaced", "global-credit-card"]
CARD_WORDS = [
    "card", "credit", "debit", "visa", "mastercard", "amex", "american express", "discover", "cvv", "cvc", "cvv2", "cvc2", "expiry", "expiration", "exp date", "valid thru", "valid through", "cardholder", "card number",
    "card no", "payment card", "credit card", "debit card", "kort", "kreditkort", "betalingskort", "dankort", "karte", "kreditkarte", "bankkarte", "gültig bis",
]
CONFIDENCE_CAPS = {"fallback": "medium", "inferred": "high", "confirmed": "critical"}
# Explanation and escalation of signal types, and what overrides them, in order: (conditions, explanation, escalation).
MAPPINGS: dict[str, tuple[str, str, list[tuple[dict[str, str], str | None, str | None]]]] = {
    "secret.api_key": ("secret.api_key", "modal", [({"destination": "internal_ai"}, None, "inline")]),
    "secret.aws_key": ("secret.api_key", "modal", []),
    "secret.password": ("secret.generic_pass", "modal", []),
    "code_block": ("gen.code.block", "inline", [({"department": "engineering", "intent": "refactor"}, None, "none"), ({"department": "marketing"}, None, "modal")]),
    "pii.ssn": ("pii.ssn.generic", "modal", [({"locale_group": "US"}, "pii.ssn.us", "modal")]),
    "pii.iban": ("dict.finance.banking", "inline", [({"locale_group": "EU"}, None, "modal")]),
    "pii.phone": ("pii.phone.generic", "none", [({"locale_group": "EU", "locale_profile": "EU-NORDICS"}, "pii.phone.nordics", "inline")]),
    "pii.contact_batch": ("pii.contact_list", "inline", []),
    "dict.legal.privilege": ("dict.legal.privileged", "modal", [({"department": "legal", "destination": "internal_ai"}, None, "none")]),
    "dict.legal.language": ("dict.legal.generic", "inline", []),
    "dict.hr.medical": ("dict.hr.sensitive", "modal", []),
    "dict.hr.salary": ("dict.hr.sensitive", "modal", []),
    "dict.finance.projections": ("dict.finance.revenue", "modal", []),
    "dict.finance.banking": ("dict.finance.banking", "inline", []),
    "pii.email_batch": ("pii.contact_list", "inline", []),
}
# The mapper's type of an explanation; others stand for themselves.
SIGNAL_TYPES = {
    "secret.private_key": "secret.password", "pii.ssn.locale_gated": "pii.ssn", "pii.credit_card": "pii.ssn", "pii.phone.density": "pii.contact_batch", "pii.email": "pii.phone", "pii.email.density": "pii.email_batch", "pii.employee": "dict.hr.salary",
    "pii.compensation": "dict.hr.salary", "financial.iban": "pii.iban", "financial.banking": "dict.finance.banking", "financial.data": "dict.finance.projections", "legal.contract": "dict.legal.language", "legal.nda": "dict.legal.privilege",
    "confidential.marker": "dict.legal.privilege", "confidential.ma": "dict.finance.projections", "dictionary.finance": "dict.finance.banking", "dictionary.hr": "dict.hr.salary", "dictionary.legal": "dict.legal.privilege", "dictionary.match": "dict.legal.language", "ip.content": "dict.legal.privilege",
}
CONDITIONS = ("department", "destination", "intent", "locale_group", "locale_profile")


def _any_of(ids: Column, known: list[str]) -> Column:
    return F.exists(ids, lambda i: F.coalesce(i.isin(*known), F.lit(False)))


def _named(keys: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), keys)


def inferred_context(text: Column, guarded: bool = False) -> Column:
    """hr, legal or pii by what a text says, or null: two words of a kind, or one with a personal number; guarded by the columns of ``prefilter.facts``."""
    count = lambda patterns: reduce(lambda a, b: a + b, [prefilter.holds(text, p, "i", guarded).cast("int") for p in patterns])
    hr, legal, cpr = count(HR_CONTEXT), count(LEGAL_CONTEXT), prefilter.holds(text, CPR_FORM, "", guarded)
    return (
        F.when((hr >= 2) | ((hr >= 1) & (legal >= 1)), "hr")
        .when(legal >= 2, "legal")
        .when((hr >= 1) & cpr, "hr")
        .when((legal >= 1) & cpr, "legal")
        .when(cpr, "pii")
    )


def dominance(ids: Column, document_class: Column, inferred: Column) -> Column:
    """Driving ids in the order they are shown in: (ids, reordered, promoted, demoted, rule_id).

    Where cards drive in a document of persons, contracts or health, ids of its kind come first and
    cards last; the rest keeps its place. ``inferred`` is the context of the text, for documents that
    neither class nor ids place.
    """
    personal = _any_of(ids, HR_IDS) | (_any_of(ids, PII_IDS) & document_class.isNull())
    kind = (
        F.when(document_class.isin("doc.payroll", "doc.hr_record"), "hr")
        .when(document_class == "doc.medical_record", "medical")
        .when(document_class == "doc.legal_contract", "legal")
        .when(document_class == "doc.insurance_policy", "pii")
        .when(personal, "hr")
        .when(_any_of(ids, LEGAL_IDS), "legal")
    )
    guessed = kind.isNull()
    kind = F.coalesce(kind, inferred)
    rule = F.when(guessed, _named(inferred, INFERRED_RULES)).when(kind == "medical", MEDICAL_RULE).when(kind == "legal", LEGAL_RULE).otherwise(HR_RULE)
    preferred = lambda i: i.isin(*PII_IDS) | ((kind == "hr") & i.isin(*HR_IDS)) | ((kind == "legal") & i.isin(*LEGAL_IDS)) | ((kind == "medical") & i.isin(*MEDICAL_IDS))
    first = F.filter(ids, preferred)
    cards = F.filter(ids, lambda i: i.isin(*CARD_IDS) & ~preferred(i))
    others = F.filter(ids, lambda i: ~i.isin(*CARD_IDS) & ~preferred(i))
    # whether there is anything to order
    acts = (F.size(ids) > 1) & _any_of(ids, CARD_IDS) & kind.isNotNull() & ((F.size(first) > 0) | guessed)
    ordered = F.when(F.coalesce(acts, F.lit(False)), F.concat(first, others, cards)).otherwise(ids)
    moved = F.coalesce(F.get(ordered, F.lit(0)) != F.get(ids, F.lit(0)), F.lit(False))
    return F.struct(
        ordered.alias("ids"),
        moved.alias("reordered"),
        F.when(moved, F.coalesce(F.get(first, F.lit(0)), F.get(others, F.lit(0)))).alias("promoted"),
        F.when(moved, F.get(cards, F.lit(0))).alias("demoted"),
        F.when(F.size(ids) <= 1, NO_DOMINANCE).when(~_any_of(ids, CARD_IDS), NO_CARDS).when(F.coalesce(acts, F.lit(False)), rule).otherwise(NO_DOMINANCE).alias("rule_id"),
    )


def domain_of(signal_id: Column) -> Column:
    """medical, legal, hr, financial or other: the first domain whose primary ids or parts fit."""
    lower, out = F.lower(signal_id), F.lit("other")
    for name, (primary, _, parts) in reversed(DOMAINS.items()):
        fits = signal_id.isin(*primary)
        for p in parts:
            fits = fits | F.contains(lower, F.lit(p))
        out = F.when(fits, name).otherwise(out)
    return out


def identity(ids: Column, document_class: Column) -> Column:
    """How far the ids establish what a document is: (confidence, domain, rule_id).

    A class is strong; so are two primary ids of a domain, or one with a corroborating id, and ids of two
    domains together; one domain alone is weak.
    """
    domains = F.transform(ids, domain_of)
    held = lambda name: F.array_contains(domains, name)

    def corroborated(name: str) -> Column:
        primary, more, _ = DOMAINS[name]
        own = F.size(F.filter(ids, lambda i: i.isin(*primary)))
        return held(name) & ((own >= 2) | ((own >= 1) & _any_of(ids, more)))

    families = reduce(lambda a, b: a + b, [held(name).cast("int") for name in DOMAINS])
    proven = F.when(corroborated("medical"), "medical").when(corroborated("legal"), "legal").when(corroborated("hr"), "hr")
    single = F.when(held("medical"), "medical").when(held("legal"), "legal").when(held("hr"), "hr")
    several = families >= 2
    return F.struct(
        F.when(document_class.isNotNull() | proven.isNotNull() | several, "strong").when(single.isNotNull(), "weak").otherwise("none").alias("confidence"),
        F.when(document_class.isNotNull(), F.coalesce(_named(document_class, CLASS_DOMAINS), F.lit("other"))).when(proven.isNotNull(), proven).when(several, F.lit(None)).otherwise(single).alias("domain"),
        F.when(document_class.isNotNull(), "IC-001-doc-class-confirmed").when(proven.isNotNull(), "IC-002-corroborated").when(several, "IC-005-multi-family-strong").when(single.isNotNull(), "IC-003-single-signal-weak").otherwise("IC-004-no-domain-signals").alias("rule_id"),
    )


def identity_label(signal_id: Column, confidence: Column, document_class: Column) -> Column:
    """The identity's name where it is strong or classed, its terminology where not; null for other ids."""
    strong = (confidence == "strong") | document_class.isNotNull()
    return F.when(strong, _named(signal_id, {k: v[0] for k, v in IDENTITY_LABELS.items()})).otherwise(_named(signal_id, {k: v[1] for k, v in IDENTITY_LABELS.items()}))


def contextual_cap(signals: Column, archetypes: Column) -> Column:
    """The worst severity of signals (array of id, severity), capped where the document's kind explains it: (severity, capped, raw).

    Only identifiers at critical become high among health, employment or insurance; only birth dates at
    high become medium in insurance; only incidental finance at medium becomes low in resumes.
    """
    ids = F.transform(signals, lambda s: s["id"])
    top = F.greatest(F.coalesce(F.array_max(F.transform(signals, lambda s: rank(s["severity"]))), F.lit(1)), F.lit(1))
    only = lambda r, known: F.forall(signals, lambda s: (rank(s["severity"]) != r) | F.coalesce(s["id"].isin(*known), F.lit(False)))
    medical = _any_of(ids, MEDICAL_CONTEXT) | _any_of(archetypes, ["medical_record", "medical_health"])
    context = medical | _any_of(ids, EMPLOYMENT_CONTEXT) | _any_of(ids, INSURANCE_CONTEXT)
    capped = (
        ((top == 4) & only(4, CAPPED_IDS) & context)
        | ((top == 3) & only(3, BIRTH_IDS) & _any_of(ids, INSURANCE_CONTEXT))
        | ((top == 2) & F.array_contains(archetypes, "resume_cv") & only(2, INCIDENTAL_IDS))
    ) & (F.size(signals) > 0)
    return F.struct(level(F.when(capped, top - 1).otherwise(top)).alias("severity"), capped.alias("capped"), level(top).alias("raw"))


def near_card_words(text: Column, place: Column, length: Column) -> Column:
    """Whether a word of cards is within 100 characters of a match."""
    return contains_any(F.lower(around(text, place, length, 100)), CARD_WORDS)


def card_most(confidence: Column, match: Column, near: Column) -> Column:
    """The most severe level of a payment card: by confidence, by its digits and by words near it."""
    good = gates.payment_card(match)
    return (
        F.when(confidence == "fallback", "medium")
        .when(match.isNull(), _named(confidence, CONFIDENCE_CAPS))
        .when(~good, "medium")
        .when(near & (confidence == "confirmed"), "critical")
        .otherwise("high")
    )


def ladder(severity: Column, signal_id: Column, confidence: Column, match: Column, near: Column) -> Column:
    """A signal's severity, capped by the surface confidence; cards by ``card_most``."""
    most = F.when(F.coalesce(signal_id.isin(*PAYMENT_IDS), F.lit(False)), card_most(confidence, match, near)).otherwise(_named(confidence, CONFIDENCE_CAPS))
    return level(F.least(rank(severity), rank(most)))


def medical_escalation(severity: Column, escalation: Column, document_class: Column, patient: Column, visible: Column, reference: Column) -> Column:
    """Medical records of a patient are high at least, shown at once, with a signal to show: (severity, escalation, rescued, escalated, rule_id).

    ``visible`` counts visible signals; ``reference`` marks reference works without persons, which stay as they are.
    """
    medical = F.coalesce(document_class == "doc.medical_record", F.lit(False))
    acts = medical & ~reference & patient
    low, quiet, unseen = rank(severity) < 3, escalation != "modal", visible == 0
    rule = (
        F.when(~medical, "MRE-011-not-medical")
        .when(reference, "MRE-012-clinical-reference-bypass")
        .when(~patient, "MRE-010-no-patient-context")
        .otherwise("MRE-001-severity-floor")
    )
    return F.struct(
        F.when(acts & low, "high").otherwise(severity).alias("severity"), F.when(acts, "modal").otherwise(escalation).alias("escalation"), F.when(acts & unseen, "doc.medical_record").alias("rescued"),
        (acts & (low | quiet | unseen)).alias("escalated"), rule.alias("rule_id"),
    )


def medical_violations(severity: Column, escalation: Column, document_class: Column, patient: Column, visible: Column) -> Column:
    """What a decision on a patient's record lacks, in words; empty when it complies or is of another kind."""
    applies = F.coalesce(document_class == "doc.medical_record", F.lit(False)) & patient
    lacks = F.array(F.when(rank(severity) < 3, "severity"), F.when(escalation != "modal", "escalation"), F.when(visible == 0, "visible signal"))
    return F.when(applies, F.array_compact(lacks)).otherwise(F.array().cast("array<string>"))


def _regulated(signals: Column) -> Column:
    return F.filter(signals, lambda s: calibration.is_regulated(s["id"], s["type"]))


def best_rescue(signals: Column) -> Column:
    """The regulated signal to show when none is: the most severe, then the earliest prefix, then the first."""
    prefix = lambda i: reduce(lambda out, kp: F.when(F.lower(i).startswith(kp[1]), kp[0]).otherwise(out), reversed(list(enumerate(calibration.REGULATED_PREFIXES))), F.lit(len(calibration.REGULATED_PREFIXES)))
    keyed = F.transform(signals, lambda s, k: F.struct((-rank(s["severity"])).alias("r"), F.coalesce(prefix(s["id"]), F.lit(len(calibration.REGULATED_PREFIXES))).alias("p"), k.alias("k"), s.alias("s")))
    kept = F.filter(keyed, lambda e: calibration.is_regulated(e["s"]["id"], e["s"]["type"]))
    return F.get(F.array_sort(F.transform(kept, lambda e: F.struct(e["r"].alias("r"), e["p"].alias("p"), e["k"].alias("k"), F.coalesce(e["s"]["id"], F.concat(F.lit("legacy."), e["s"]["type"])).alias("id"), e["s"]["severity"].alias("severity")))), F.lit(0))


def regulated_visibility(signals: Column, visible: Column, severity: Column, escalation: Column) -> Column:
    """Where anything regulated was found, one such signal is visible: (severity, escalation, rescued, enforced, rule_id).

    ``signals`` and ``visible`` are arrays of (id, type, severity). The severity is then low at least, or
    the rescued signal's, and the escalation inline at least.
    """
    any_, seen = F.size(_regulated(signals)) > 0, F.size(_regulated(visible)) > 0
    fine = seen & (rank(severity) >= 1)
    rescued = F.when(any_ & ~seen, best_rescue(signals))
    floor = F.when(any_ & ~fine, F.greatest(F.coalesce(rank(rescued["severity"]), F.lit(1)), F.lit(1))).otherwise(0)
    raised, quiet = rank(severity) < floor, escalation == "none"
    return F.struct(
        F.when(raised, level(floor)).otherwise(severity).alias("severity"), F.when(any_ & quiet, "inline").otherwise(escalation).alias("escalation"), rescued["id"].alias("rescued"), (any_ & (quiet | rescued.isNotNull() | raised)).alias("enforced"),
        F.when(~any_, "VGR-010-no-regulated").when(fine & quiet, "VGR-003-escalation-floor").when(fine, "VGR-011-already-visible").otherwise("VGR-001-signal-rescued").alias("rule_id"),
    )


def visibility_violations(signals: Column, visible: Column, severity: Column, escalation: Column) -> Column:
    """What hides regulated findings, in words; empty when nothing does."""
    lacks = F.array(F.when(F.size(_regulated(visible)) == 0, "visible signal"), F.when(rank(severity) < 1, "severity"), F.when(escalation == "none", "escalation"))
    return F.when(F.size(_regulated(signals)) > 0, F.array_compact(lacks)).otherwise(F.array().cast("array<string>"))


def consistent(details: Column, driving: Column, severity: Column) -> Column:
    """Details (array of id, severity) none of which shows more than the decision unless it drives: (details, downgraded, violations)."""
    over = lambda d: rank(d["severity"]) > rank(severity)
    down = lambda d: over(d) & ~F.array_contains(driving, d["id"])
    kept = F.transform(details, lambda d: F.struct(d["id"].alias("id"), F.when(down(d), severity).otherwise(d["severity"]).alias("severity")))
    return F.struct(kept.alias("details"), F.size(F.filter(details, down)).alias("downgraded"), F.size(F.filter(details, over)).alias("violations"))


def alarming(signal: Column, severity: Column, driving: Column) -> Column:
    """Only a driver of a high or critical decision may look alarming."""
    return driving & signal.isin("high", "critical") & severity.isin("high", "critical")


def signal_type(explanation: Column) -> Column:
    return F.coalesce(_named(explanation, SIGNAL_TYPES), explanation)


def mapping_rows(mappings: dict = MAPPINGS) -> list[tuple]:
    return [(t, e, u, [(*(c.get(k) for k in CONDITIONS), oe, ou) for c, oe, ou in overrides]) for t, (e, u, overrides) in mappings.items()]


def mapped(df: DataFrame, type_col: str = "signal_type", mappings: dict = MAPPINGS) -> DataFrame:
    """Adds explanation_id and escalation by a table of types and overrides; ``df`` has the CONDITIONS as columns.

    The table (a row a type, its overrides in order in one array) is broadcast; the first override all of
    whose conditions equal the row's context counts. Unknown types keep their name, or gen.generic, inline.
    """
    fields = ", ".join(f"{c}: string" for c in (*CONDITIONS, "explanation", "escalation"))
    table = df.sparkSession.createDataFrame(mapping_rows(mappings), f"m_type string, m_explanation string, m_escalation string, m_overrides array<struct<{fields}>>")
    joined = df.join(F.broadcast(table), df[type_col] == table["m_type"], "left")
    fits = lambda o: reduce(lambda a, b: a & b, [o[c].isNull() | F.coalesce(o[c] == F.col(c), F.lit(False)) for c in CONDITIONS])
    first = F.get(F.filter("m_overrides", fits), F.lit(0))
    unknown = F.when(F.coalesce(F.col(type_col), F.lit("")) == "", "gen.generic").otherwise(F.col(type_col))
    return joined.withColumns({
        "explanation_id": F.coalesce(first["explanation"], F.col("m_explanation"), unknown),
        "escalation": F.coalesce(first["escalation"], F.col("m_escalation"), F.lit("inline")),
    }).drop("m_type", "m_explanation", "m_escalation", "m_overrides")
