"""Severity as an ordered number, and what policy makes of it: contract, floors, aggregation, decisions.

Ranks run 0 none, 1 low, 2 medium, 3 high, 4 critical. Everything is a column expression or one
grouping by document; rule tables are literals of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = ["none", "low", "medium", "high", "critical"]
LOW, CRITICAL = 1, 4


def rank(level: Column) -> Column:
    """Unknown and null levels rank as none."""
    return F.greatest(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower(F.coalesce(level, F.lit("none")))).cast("int") - 1, F.lit(0))


def level(r: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), r.cast("int") + 1)


def bump(r: Column, n: int) -> Column:
    return F.least(r + n, F.lit(CRITICAL))


def reduce(r: Column, n: int) -> Column:
    return F.greatest(r - n, F.lit(LOW))


def cap(r: Column, most: Column | int) -> Column:
    return F.least(r, most if isinstance(most, Column) else F.lit(most))


def is_blocking(r: Column) -> Column:
    return r >= 3


@dataclass(frozen=True)
class SignalPolicy:
    base: int
    most: int = 0  # 0: no cap
    density: tuple[int, int] | None = None  # from this count on, this severity
    mandatory: bool = False
    transactional: bool = False


# The policy contract.
POLICY: dict[str, SignalPolicy] = {
    "pii.phone": SignalPolicy(1, 2, (10, 2), transactional=True),
    "pii.email": SignalPolicy(1, 2, (5, 2), transactional=True),
    "pii.ssn_us": SignalPolicy(4, mandatory=True),
    "pii.national_id": SignalPolicy(3),
    "pii.name": SignalPolicy(1, 2, transactional=True),
    "secrets.api_key": SignalPolicy(4, mandatory=True),
    "secrets.aws_key": SignalPolicy(4, mandatory=True),
    "secrets.password": SignalPolicy(4, mandatory=True),
    "secrets.private_key": SignalPolicy(4, mandatory=True),
    "secrets.bearer_token": SignalPolicy(4, mandatory=True),
    "secrets.connection_string": SignalPolicy(4, mandatory=True),
    "financial.credit_card": SignalPolicy(4, mandatory=True),
    "financial.iban": SignalPolicy(3),
    "financial.banking": SignalPolicy(3),
    "confidential.marker": SignalPolicy(3, mandatory=True),
    "confidential.ma_terms": SignalPolicy(4, mandatory=True),
    "legal.agreement": SignalPolicy(2),
    "hr.employee_data": SignalPolicy(3),
}
PHONE_DENSITY = {"EU-NORDICS": 20, "EU-DACH": 15, "LATAM": 15}
SSN_LOCALES = ("US", "unknown")
ALWAYS = ["secrets.api_key", "secrets.aws_key", "secrets.password", "secrets.private_key", "secrets.bearer_token", "secrets.connection_string", "financial.credit_card", "confidential.marker", "confidential.ma_terms"]
TOGETHER = {"pii.phone": 5, "pii.email": 5}  # both from these counts on: one level more, medium at most
POLICY_OF = {
    "phone": "pii.phone", "email": "pii.email", "ssn": "pii.ssn_us", "api-key": "secrets.api_key", "aws-key": "secrets.aws_key",
    "password": "secrets.password", "credit-card": "financial.credit_card", "iban": "financial.iban", "banking": "financial.banking",
    "confidential-marker": "confidential.marker", "ma-terms": "confidential.ma_terms", "legal-agreement": "legal.agreement",
    "hr-data": "hr.employee_data", "author-name": "pii.name", "company-name": "pii.name",
}
# Parts of a description (all of a group's alternatives must be met) and the key they stand for, in order.
KEY_PARTS: list[tuple[str, list[list[str]]]] = [
    ("api-key", [["api key", "access token"]]),
    ("aws-key", [["aws"], ["key"]]),
    ("password", [["password"]]),
    ("ssn", [["ssn", "social security"]]),
    ("credit-card", [["credit card", "payment card"]]),
    ("confidential-marker", [["confidentiality", "confidential"]]),
    ("ma-terms", [["m&a", "merger", "acquisition"]]),
    ("legal-agreement", [["legal"], ["agreement", "contract"]]),
    ("phone", [["phone"]]),
    ("email", [["email"]]),
    ("iban", [["iban"]]),
    ("banking", [["banking", "wire", "routing"]]),
    ("financial-data", [["financial", "budget", "revenue"]]),
    ("author-name", [["author"]]),
    ("company-name", [["corporate"], ["document"]]),
    ("employee-data", [["employee", "hr", "personnel"]]),
    ("ip-content", [["patent", "intellectual", "trade secret"]]),
    ("sensitive-dept", [["sensitive department", "legal, finance"]]),
]


def pattern_key(description: Column) -> Column:
    """The policy key that a description's words stand for; null if none."""
    d = F.lower(description)
    out = F.lit(None).cast("string")
    for key, groups in reversed(KEY_PARTS):
        met = F.lit(True)
        for words in groups:
            one = F.lit(False)
            for w in words:
                one = one | F.contains(d, F.lit(w))
            met = met & one
        out = F.when(met, key).otherwise(out)
    return out


def described_count(description: Column) -> Column:
    n = F.regexp_extract(description, r"(?i)([0-9]+)\s+(email|phone|address)", 1)
    return F.when(n != "", n.try_cast("int")).otherwise(1)


def _by_policy(key: Column, values: dict[str, object]) -> Column:
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), key)


def apply_policy(signals: DataFrame) -> DataFrame:
    """The contract's severity for each signal, as ``policy_severity`` (and ``policy_id``).

    Reads severity, description, locale, phone_count, email_count, ssn_count, transactional. In order:
    base (or at least base, where mandatory), density, co-occurrence, transactional, cap, mandatory
    minimum. Signals without a policy keep their severity. One projection; no join.
    """
    pid = _by_policy(F.col("policy_key"), POLICY_OF)
    df = signals.withColumn("policy_key", pattern_key(F.col("description"))).withColumn("policy_id", pid)
    p = F.col("policy_id")
    base = _by_policy(p, {k: v.base for k, v in POLICY.items()})
    mandatory = _by_policy(p, {k: v.mandatory for k, v in POLICY.items()})
    most = _by_policy(p, {k: v.most or CRITICAL for k, v in POLICY.items()})
    american = F.col("locale").isin(*SSN_LOCALES)
    base = F.when((p == "pii.ssn_us") & ~american, 1).otherwise(base)
    mandatory = F.when((p == "pii.ssn_us") & ~american, False).otherwise(mandatory)
    own = rank(F.col("severity"))
    r = F.when(mandatory, F.greatest(own, base)).otherwise(base)
    phones = F.coalesce(_by_policy(F.col("locale"), PHONE_DENSITY), F.lit(POLICY["pii.phone"].density[0]))
    dense = ((p == "pii.phone") & (F.col("phone_count") >= phones)) | ((p == "pii.email") & (F.col("email_count") >= POLICY["pii.email"].density[0]))
    r = F.when(dense, 2).otherwise(r)
    both = (F.col("phone_count") >= TOGETHER["pii.phone"]) & (F.col("email_count") >= TOGETHER["pii.email"])
    r = F.when(both & p.isin(*TOGETHER), cap(bump(r, 1), 2)).otherwise(r)
    eased = _by_policy(p, {k: v.transactional and not v.mandatory for k, v in POLICY.items()})
    r = F.when(F.col("transactional") & eased, reduce(r, 1)).otherwise(r)
    r = F.least(r, most)
    r = F.when(p.isin(*ALWAYS), F.greatest(r, F.lit(3))).otherwise(r)
    return df.withColumn("policy_severity", level(F.when(p.isNotNull(), r).otherwise(own)))


def deduplicate(signals: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first signal (by seq) for each id-or-type, place and source of a document."""
    key = F.concat_ws(":", F.coalesce("id", "type"), F.coalesce(F.col("offset").cast("string"), F.lit("none")), F.col("source"))
    first = F.row_number().over(Window.partitionBy(*keep, key).orderBy("seq"))
    return signals.withColumn("__n", first).where("__n = 1").drop("__n")


def signal_identifier(id_: Column, type_: Column, description: Column) -> Column:
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(description), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 50)
    return F.coalesce(id_, F.concat(type_, F.lit(":"), slug))


def aggregate_severity(docs: DataFrame, signals: DataFrame, severity_col: str = "severity") -> DataFrame:
    """One row a document: severity, driving_ids, driving_sources, signal_count.

    The highest severity wins; its signals drive the decision, most confident first (0.5 where
    unknown), then by id. Documents without signals have severity none. One grouping by document with
    map-side combining: structs are collected per rank and the top one is taken.
    """
    entry = F.struct((-F.coalesce("confidence", F.lit(0.5))).alias("c"), signal_identifier(F.col("id"), F.col("type"), F.col("description")).alias("id"), F.col("source").alias("source"))
    ranked = signals.select("doc_id", rank(F.col(severity_col)).alias("r"), entry.alias("e"))
    per = ranked.groupBy("doc_id", "r").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("e")).alias("es"))
    top = per.groupBy("doc_id").agg(F.max(F.struct("r", "es")).alias("top"), F.sum("n").alias("signal_count"))
    out = docs.select("doc_id").join(top, "doc_id", "left")
    es = F.coalesce(F.col("top.es"), F.array().cast("array<struct<c: double, id: string, source: string>>"))
    return out.select(
        "doc_id",
        level(F.coalesce(F.col("top.r"), F.lit(0))).alias("severity"),
        F.transform(es, lambda e: e["id"]).alias("driving_ids"),
        F.array_sort(F.array_distinct(F.transform(es, lambda e: e["source"]))).alias("driving_sources"),
        F.coalesce("signal_count", F.lit(0)).cast("long").alias("signal_count"),
    )


def _has(id_: Column, starts: list[str], parts: list[str]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | id_.startswith(s)
    for s in parts:
        out = out | F.contains(id_, F.lit(s))
    return F.coalesce(out, F.lit(False))


def category_flags(signals: DataFrame) -> dict[str, Column]:
    """Which regulated categories a signal belongs to, by its id and type."""
    i, t = F.lower(F.coalesce("id", F.lit(""))), F.lower(F.coalesce("type", F.lit("")))
    return {
        "secret": _has(i, ["secret.", "secret-"], ["api_key", "api-key", "password", "private_key", "private-key", "bearer_token", "bearer-token"]),
        "pii": _has(i, ["pii.", "pii-", "registry-"], []) | (t == "pii"),
        "hr": _has(i, ["hr-", "hr."], ["employee", "compensation", "salary", "payroll"]),
        "legal": _has(i, ["legal.", "legal-"], ["contract", "nda", "privileged"]),
        "financial": _has(i, ["financial.", "financial-"], ["credit_card", "credit-card", "iban", "banking"]) | (t == "financial"),
        "critical_financial": _has(i, [], ["credit_card", "credit-card"]) | (F.col("severity") == "critical"),
    }


CATEGORIES = ("secret", "pii", "hr", "legal", "financial")


def category_counts(signals: DataFrame) -> list[Column]:
    """Aggregates that a floor is made of: how many signals of each category a document has."""
    f = category_flags(signals)
    return [*[F.count_if(f[k]).alias(f"__{k}") for k in CATEGORIES], F.count_if(f["financial"] & f["critical_financial"]).alias("__critical_financial")]


def floor_of(document_class: Column | None = None) -> tuple[Column, Column]:
    """(rank, categories met) from the columns of category_counts."""
    c = {k: F.coalesce(f"__{k}", F.lit(0)) for k in (*CATEGORIES, "critical_financial")}
    hr = c["hr"] > 0
    if document_class is not None:
        hr = hr | F.coalesce(document_class.isin("doc.hr_record", "doc.payroll"), F.lit(False))
    floor = F.greatest(
        F.when(c["secret"] > 0, 3).otherwise(0),
        F.when(c["pii"] >= 3, 3).when(c["pii"] > 0, 2).otherwise(0),
        F.when(hr, 2).otherwise(0),
        F.when(c["legal"] > 0, 2).otherwise(0),
        F.when(c["financial"] > 0, F.when(c["critical_financial"] > 0, 3).otherwise(2)).otherwise(0),
    )
    met = {k: c[k] > 0 for k in CATEGORIES} | {"hr": hr}
    return floor, F.array_compact(F.array(*[F.when(met[k], k) for k in CATEGORIES]))


def severity_floor(signals: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """One row a document with signals: floor, categories. ``classes`` may give doc_id, document_class."""
    counts = signals.groupBy("doc_id").agg(*category_counts(signals))
    if classes is not None:
        counts = counts.join(classes.select("doc_id", "document_class"), "doc_id", "left")
    floor, categories = floor_of(F.col("document_class") if classes is not None else None)
    return counts.select("doc_id", level(floor).alias("floor"), categories.alias("categories"))


def action(severity: Column, destination: Column) -> Column:
    return (
        F.when(severity == "critical", "block")
        .when(severity == "high", F.when(F.coalesce(destination, F.lit("")) == "internal_ai", "warn").otherwise("block"))
        .when(severity == "medium", "warn")
        .otherwise("allow")
    )


# Least severity of each document class.
CLASS_BASELINE = {"doc.payroll": 3, "doc.hr_record": 3, "doc.insurance": 3, "doc.health_certificate": 3, "doc.medical_record": 4, "doc.legal_contract": 2, "doc.invoice": 1}


def authoritative(aggregate: Column, document_class: Column, identity: Column) -> Column:
    """The higher of aggregate and class baseline; a critical baseline counts as high unless identity is strong."""
    base = F.coalesce(_by_policy(document_class, CLASS_BASELINE), F.lit(0))
    base = F.when((base == 4) & (F.coalesce(identity, F.lit("")) != "strong"), 3).otherwise(base)
    return level(F.greatest(rank(aggregate), base))


def visibility(severity: Column, signal_count: Column, escalation: Column, limited: Column) -> Column:
    r = rank(severity)
    return (
        F.when((r >= 2) | (escalation == "modal") | limited, "interrupt")
        .when((signal_count == 0) & (r == 0), "notice")
        .when((r == 1) & (escalation == "inline"), "notice")
        .otherwise("interrupt")
    )
