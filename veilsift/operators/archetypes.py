"""Archetypes of documents by their marks, and what severity their risk contracts make of the signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import prefilter
from ..functions.patterns import found
from ..plans import archetype_words as words
from .severity import level, rank

# Archetypes in the order they are looked for; one of them shares the marks of another.
ORDER = ["resume_cv", "ticket_booking", "invoice_receipt", "medical_record", "legal_authority", "medical_health", "employment_hr", "insurance", "education_school", "template_governance", "policy_standard", "clinical_reference", "aggregate_hr_finance"]
SHARED = {"medical_health": "medical_record"}
# Least strong marks, least marks, and marks that make an archetype strong without strong ones.
THRESHOLDS = {"template_governance": (1, 3, 5), "policy_standard": (1, 3, 5), "clinical_reference": (1, 3, 5), "aggregate_hr_finance": (2, 4, 6)}
# What a strong archetype may do to generic keywords and to classes.
VETO_KEYWORDS = ["template_governance", "policy_standard", "aggregate_hr_finance"]
VETO_CLASSES = {"invoice_receipt": ["doc.legal_contract"], "education_school": ["doc.hr_record"], "template_governance": ["doc.hr_record", "doc.legal_contract"], "policy_standard": ["doc.hr_record", "doc.legal_contract"], "clinical_reference": ["doc.medical_record"]}
prefilter.register(p for marks in words.MARKERS.values() for known in marks for p in known)
prefilter.register(words.CONTRACT)
GENERIC_IDS = ["registry-hr-employee", "english-hr-performance", "english-hr-compensation", "global-swift", "english-financial-statement", "nordic-financial-terms", "global-financial-report"]
# Signals that no archetype may silence, and the most severe that summaries of staff and finance get without one.
PROTECTED_IDS = [
    "global-national-id", "global-dk-cpr", "global-se-personnummer", "global-no-fnr", "global-fi-hetu", "registry-dk-cpr", "registry-se-personnummer", "registry-no-fnr", "registry-fi-hetu", "registry-ssn-us",
    "global-email", "registry-email", "global-phone", "registry-phone",
    "global-iban", "global-credit-card", "registry-credit-card", "global-bank-account",
    "global-api-key-sk", "global-aws-access-key", "global-password-assignment",
]
SEVERITY_CAPS = {"aggregate_hr_finance": "medium"}
# Groups of signals that contracts look at.
GROUPS = {
    "identity_strong": ["global-national-id", "global-dk-cpr", "global-se-personnummer", "global-no-fnr", "registry-ssn-us", "registry-dk-cpr", "registry-se-personnummer", "registry-no-fnr"],
    "identity_basic": ["global-email", "english-phone-us-formatted", "english-phone-intl-prefix", "english-phone-uk-format", "nordic-phone-dk-intl", "nordic-phone-se-intl", "nordic-phone-no-intl", "nordic-phone-fi-intl", "nordic-phone-labeled"],
    "health_sensitive": ["registry-medical-content", "registry-icd10-code", "english-health-phi"],
    "financial_sensitive": ["global-iban", "global-credit-card", "registry-credit-card-spaced", "global-swift"],
    "employment_sensitive": ["registry-hr-employee", "english-hr-compensation", "english-hr-performance", "nordic-payroll-terms", "nordic-hr-terms"],
}
# Of each archetype, its floor (none: no floor) and its anchors (groups that must all be there, least severity).
_STRONG, _HEALTH = (["identity_strong"], "high"), (["health_sensitive"], "critical")
_PATIENT = [(["health_sensitive", "identity_basic"], "critical"), (["health_sensitive", "identity_strong"], "critical")]
CONTRACTS: dict[str, tuple[str, list[tuple[list[str], str]]]] = {
    "resume_cv": ("none", [_STRONG, _HEALTH]),
    "ticket_booking": ("none", [_STRONG]),
    "invoice_receipt": ("none", [_STRONG]),
    "medical_record": ("high", _PATIENT),
    "legal_authority": ("none", [_STRONG, _HEALTH]),
    "medical_health": ("high", _PATIENT),
    "employment_hr": ("medium", [(["employment_sensitive"], "high"), _STRONG, _HEALTH]),
    "insurance": ("medium", [_STRONG, _HEALTH]),
    "education_school": ("medium", [_STRONG, _HEALTH]),
    "template_governance": ("none", [_STRONG, _HEALTH]),
    "policy_standard": ("none", [_STRONG, _HEALTH]),
    "clinical_reference": ("none", [_STRONG, _HEALTH]),
    "aggregate_hr_finance": ("none", [_STRONG]),
}
# Marks of business partners, by which an IBAN is no person's.
BUSINESS = [(r"\bVAT\b", "i"), (r"\bCVR\b", "i"), (r"\bOrg\.?\s*(?:nr|nummer)\b", "i"), (r"\bInc\b", "i"), (r"\bLtd\b", "i"), (r"\bGmbH\b", "i"), (r"\bApS\b", "i"), (r"\bA\/S\b", "i"), (r"\bAB\b", ""), (r"\bAS\b", ""), (r"\bSARL\b", "i"), (r"\bSL\b", ""), (r"\bAG\b", "")]


def _hits(text: Column, patterns: list[str], guarded: bool) -> Column:
    return reduce(lambda a, b: a + b, [prefilter.holds(text, p, "i", guarded).cast("int") for p in patterns])


def detect(text: Column, guarded: bool = False) -> Column:
    """Archetypes of a text, strong ones first, then by number of marks: array of (id, strong, marks).

    Texts under 50 characters have none; equals stay in ORDER; two marks of a contract rule out a policy.
    """
    # marks are counted once each, in an array of their own; what reads them are functions of its elements
    counts = []
    for a, (strong_marks, other) in words.MARKERS.items():
        uses = [(ORDER.index(b), b, *THRESHOLDS.get(b, (1, 2, 4))) for b in ORDER if SHARED.get(b, b) == a]
        ruled_out = _hits(text, words.CONTRACT, guarded) >= 2 if a == "policy_standard" else F.lit(False)
        names = ("k", "id", "least_strong", "least", "enough")
        told = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, u, strict=True)]) for u in uses])
        counts.append(F.struct(_hits(text, strong_marks, guarded).alias("strong"), _hits(text, other, guarded).alias("other"), ruled_out.alias("out"), told.alias("uses")))

    def judged(c: Column) -> Column:
        total = c["strong"] + c["other"]
        fitting = F.filter(c["uses"], lambda u: (total >= u["least"]) & ~c["out"])
        return F.transform(fitting, lambda u: F.struct((~((c["strong"] >= u["least_strong"]) | (total >= u["enough"]))).alias("weak"), (-total).alias("less"), u["k"].alias("k"), u["id"].alias("id")))

    ranked = F.array_sort(F.flatten(F.transform(F.array(*counts), judged)))
    none = F.array().cast("array<struct<id: string, strong: boolean, marks: int>>")
    return F.when(F.length(text) >= 50, F.transform(ranked, lambda r: F.struct(r["id"].alias("id"), (~r["weak"]).alias("strong"), (-r["less"]).alias("marks")))).otherwise(none)


def primary(matches: Column) -> Column:
    """The first archetype's id, or null."""
    return F.get(matches, F.lit(0))["id"]


def strong_ids(matches: Column) -> Column:
    return F.transform(F.filter(matches, lambda m: m["strong"]), lambda m: m["id"])


def without_generic(ids: Column, matches: Column) -> Column:
    """Ids without generic keywords, where a strong archetype makes those say nothing."""
    vetoes = F.exists(strong_ids(matches), lambda a: a.isin(*VETO_KEYWORDS))
    return F.when(vetoes, F.filter(ids, lambda i: ~i.isin(*GENERIC_IDS))).otherwise(ids)


def vetoed_class(document_class: Column, matches: Column) -> Column:
    """The class, or null where a strong archetype rules it out."""
    out = F.lit(False)
    for a, classes in VETO_CLASSES.items():
        out = out | (F.array_contains(strong_ids(matches), a) & document_class.isin(*classes))
    return F.when(~F.coalesce(out, F.lit(False)), document_class)


def protected(ids: Column) -> Column:
    """Whether any signal points to a person, an account or a secret."""
    return F.arrays_overlap(ids, F.array(*[F.lit(k) for k in PROTECTED_IDS]))


def capped(severity: Column, ids: Column, matches: Column) -> Column:
    """The severity, capped where a strong archetype has a cap and no signal is protected."""
    most = F.lit(4)
    for a, cap_ in SEVERITY_CAPS.items():
        most = F.when(F.array_contains(strong_ids(matches), a), F.least(most, rank(F.lit(cap_)))).otherwise(most)
    return F.when(protected(ids), severity).otherwise(level(F.least(rank(severity), most)))


def groups(ids: Column) -> Column:
    """The groups that the ids are of."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(ids, F.array(*[F.lit(k) for k in known])), g) for g, known in GROUPS.items()]))


def iban_forces_high(ids: Column, text: Column) -> Column:
    """An IBAN beside a person's identity, without a mark of a business."""
    person = F.exists(groups(ids), lambda g: g.isin("identity_basic", "identity_strong"))
    business = reduce(lambda a, b: a | b, [found(text, p, f) for p, f in BUSINESS])
    return F.array_contains(ids, "global-iban") & person & ~business


def contract(severity: Column, ids: Column, archetypes: Column, text: Column) -> Column:
    """Severity by the contracts of all archetypes, the worst of them: (severity, driving, iban).

    A contract raises to its floor and to each anchor whose groups are there, and never lowers. The
    first archetype with the worst result drives. Below high, an IBAN of a person makes high.
    """
    have, was = groups(ids), rank(severity)

    def reached(archetype: Column) -> Column:
        out = F.lit(0)
        for name, (floor, anchors) in CONTRACTS.items():
            most = rank(F.lit(floor))
            for needs, least in anchors:
                fires = reduce(lambda x, y: x & y, [F.array_contains(have, g) for g in needs])
                most = F.greatest(most, F.when(fires, rank(F.lit(least))).otherwise(0))
            out = F.when(archetype == name, most).otherwise(out)
        return out

    worst = F.greatest(was, F.coalesce(F.array_max(F.transform(archetypes, reached)), F.lit(0)))
    driving = F.when(worst > was, F.get(F.filter(archetypes, lambda a: reached(a) == worst), F.lit(0)))
    iban = (worst < 3) & iban_forces_high(ids, text)
    return F.struct(level(F.when(iban, 3).otherwise(worst)).alias("severity"), driving.alias("driving"), iban.alias("iban"))
