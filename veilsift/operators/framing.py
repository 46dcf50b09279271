"""What a decision says of itself: families of its drivers, surface confidence, disclosure, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families of signals (label, parts of an id), the first that fits counts.
FAMILIES = [
    ('medical', ['medical', 'health', 'clinical', 'icd', 'coa-', 'patient', 'diagnosis', 'prescription']),
    ('legal', ['legal.', 'contract', 'nda', 'agreement', 'privileged', 'attorney', 'litigation']),
    ('financial', ['financial.', 'banking', 'iban', 'credit_card', 'payment', 'invoice', 'salary', 'compensation']),
    ('personal', ['pii.', 'ssn', 'national_id', 'phone', 'email', 'address', 'dob', 'employee']),
    ('HR', ['hr.', 'employee', 'payroll', 'benefits', 'performance', 'termination']),
    ('credentials', ['secret.', 'api_key', 'password', 'private_key', 'bearer_token', 'connection_string']),
]
# Parts of an id that confirm a domain on their own.
STRONG_PARTS = ["medical", "clinical", "icd", "cpt", "nda", "contract", "ssn", "passport", "card-", "iban", "api-key", "password"]


def _has_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def family(signal_id: Column) -> Column:
    i = F.lower(signal_id)
    out = F.lit(None).cast("string")
    for label, parts in reversed(FAMILIES):
        out = F.when(_has_any(i, parts), label).otherwise(out)
    return out


def families(ids: Column) -> Column:
    """The families of some ids, each once, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(ids, family))))


def family_list(names: Column) -> Column:
    """Families in words: one, two with and, more with commas and a last and."""
    n = F.size(names)
    last = F.element_at(names, -1)
    return F.concat(
        F.when(n == 0, "sensitive").when(n == 1, F.array_join(names, "")).when(n == 2, F.array_join(names, " and ")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), last)),
        F.lit(" information"),
    )


def surface_confidence(document_class: Column, ids: Column, severity: Column, count: Column) -> Column:
    """confirmed, inferred or fallback, by class, number, families and strong domains of the drivers."""
    strong = F.exists(ids, lambda i: _has_any(F.lower(i), STRONG_PARTS))
    return (
        F.when(document_class.isNotNull(), "confirmed")
        .when((count == 0) | (F.size(ids) == 0), "fallback")
        .when(severity.isin("high", "critical") & (count >= 2), "confirmed")
        .when((F.size(families(ids)) >= 2) | strong, "confirmed")
        .otherwise("inferred")
    )


def disclosure(severity: Column) -> Column:
    return F.when(severity.isin("high", "medium"), "standard").otherwise("minimal")


def display_severity(severity: Column, confidence: Column) -> Column:
    return F.when((severity == "critical") & (confidence == "inferred"), "high").otherwise(severity)


def locale_group(locale: Column) -> Column:
    p = F.upper(F.coalesce(locale, F.lit("")))
    return F.when(p.isin("US", "UK", "LATAM"), p).when(p.startswith("EU-"), "EU").when(p.startswith("EN-"), "EN").otherwise("UNKNOWN")


def shown_severity(signal: Column, decision: Column, driving: Column) -> Column:
    """A signal that does not drive shows no more than the decision's severity."""
    from .severity import rank

    return F.when(driving | (rank(signal) <= rank(decision)), signal).otherwise(decision)
