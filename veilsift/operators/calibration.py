"""Roles of signals within a document: driving, supporting or suppressed, and the rescue of regulated ones.

All counts and nearness are windows over one partitioning by document, so the table is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .severity import level, rank

# Identifiers by tier.
UNIVERSAL = ["secret.api_key", "secret.aws_key", "secret.password", "secret.private_key", "secret.bearer_token", "secret.connection_string", "secrets.api_key", "secrets.aws_key", "secrets.password", "secrets.private_key", "secrets.bearer_token", "secrets.connection_string", "pii.credit_card", "financial.credit_card", "confidential.ma_terms", "confidential.ma"]
REGION_SENSITIVE = ["pii.ssn", "pii.ssn_us", "pii.national_id", "financial.iban", "financial.banking", "legal.agreement", "legal.contract", "legal.nda", "legal.privileged"]
# Fixed values: (least severity, most severity, role) by identifier and locale; "unknown" stands for locales not named.
MODIFIERS: dict[str, dict[str, tuple[int, int, str]]] = {
    "pii.ssn": {"US": (3, 4, "driving"), "unknown": (0, 2, "supporting")} | {k: (0, 1, "suppressed") for k in ("UK", "EU-NORDICS", "EU-DACH", "EU-WESTERN", "EU-SOUTHERN", "EU-EASTERN", "EN-COMMONWEALTH", "LATAM")},
    "pii.ssn_us": {"US": (3, 4, "driving"), "unknown": (0, 2, "supporting"), "UK": (0, 1, "suppressed"), "EU-NORDICS": (0, 1, "suppressed"), "EU-DACH": (0, 1, "suppressed")},
    "financial.iban": {"US": (0, 2, "supporting"), "UK": (2, 4, "driving")} | {k: (3, 4, "driving") for k in ("EU-NORDICS", "EU-DACH", "EU-WESTERN", "EU-SOUTHERN", "EU-EASTERN")},
}
COUNT_THRESHOLDS = {"pii.phone": {"EU-NORDICS": 10, "EU-DACH": 8, "US": 5}, "pii.email": {"US": 5, "EU-NORDICS": 8, "unknown": 5}}
DEFAULT_COUNT, BOILERPLATE, REACH = 3, 5, 200
# What counts as regulated.
REGULATED_PREFIXES = ['secret.', 'secrets.', 'pii.', 'financial.', 'confidential', 'registry-', 'coa-', 'icd', 'hr-', 'legal.']
REGULATED_TYPES = ["pii", "secret", "financial", "confidential"]
STRONG = ['pii.ssn_us', 'pii.ssn', 'pii.national_id', 'financial.credit_card', 'pii.credit_card', 'secret.api_key', 'secret.aws_key', 'secret.password', 'secret.private_key', 'secret.bearer_token', 'secret.connection_string', 'secrets.api_key', 'secrets.aws_key', 'secrets.password', 'secrets.private_key', 'secrets.bearer_token', 'secrets.connection_string']


def tier(id_: Column) -> Column:
    return F.when(id_.isin(*UNIVERSAL), "universal").when(id_.isin(*REGION_SENSITIVE), "region_sensitive").otherwise("contextual")


def is_regulated(id_: Column, type_: Column) -> Column:
    i = F.lower(F.coalesce(id_, F.lit("")))
    out = type_.isin(*REGULATED_TYPES)
    for p in REGULATED_PREFIXES:
        out = out | i.startswith(p)
    return F.coalesce(out, F.lit(False))


def calibrate(signals: DataFrame) -> DataFrame:
    """Adds tier, role, calibrated (severity) and reason to signals with doc_id, seq, id, type, severity, match, offset, locale.

    Universal ids drive. Region-sensitive ones follow their locale's modifier. All others are suppressed
    unless their id occurs often enough (driving) or a universal signal is within 200 characters
    (supporting); repeated matches are boilerplate. A document without a driving signal gets one back:
    its lone strong signal, or the most severe regulated suppressed one, the first of equals.
    """
    doc, sid = Window.partitionBy("doc_id"), F.coalesce("id", F.lit("unknown"))
    df = signals.withColumn("tier", tier(sid))
    df = df.withColumn("__same_id", F.count(F.lit(1)).over(Window.partitionBy("doc_id", sid)))
    df = df.withColumn("__same_match", F.count(F.lit(1)).over(Window.partitionBy("doc_id", F.coalesce("match", sid))))
    # the nearest universal offsets on either side; null offsets take no part
    anchor = F.when(F.col("tier") == "universal", F.col("offset"))
    ordered = Window.partitionBy("doc_id").orderBy(F.col("offset").asc_nulls_first())
    before = F.max(anchor).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(anchor).over(ordered.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("__near", F.coalesce(F.least(F.col("offset") - before, after - F.col("offset")) <= REACH, F.lit(False)))

    def modifier(k: int) -> Column:
        out = F.lit(None)
        for name, rows in MODIFIERS.items():
            own = F.lit(rows["unknown"][k]) if "unknown" in rows else F.lit(None)
            for place, row in rows.items():
                own = F.when(F.col("locale") == place, row[k]).otherwise(own)
            out = F.when(sid == name, own).otherwise(out)
        return out

    threshold = F.lit(DEFAULT_COUNT)
    for name, rows in COUNT_THRESHOLDS.items():
        own = F.lit(rows.get("unknown", DEFAULT_COUNT))
        for place, n in rows.items():
            own = F.when(F.col("locale") == place, n).otherwise(own)
        threshold = F.when(sid == name, own).otherwise(threshold)
    region = F.col("tier") == "region_sensitive"
    role = (
        F.when(F.col("tier") == "universal", "driving")
        .when(region, F.coalesce(modifier(2), F.lit("driving")))
        .when(F.col("__same_match") >= BOILERPLATE, "suppressed")
        .when(F.col("__same_id") >= threshold, "driving")
        .when(F.col("__near"), "supporting")
        .otherwise("suppressed")
    )
    own = rank(F.col("severity"))
    adjusted = F.when(region, F.greatest(F.least(own, F.coalesce(modifier(1), F.lit(4))), F.coalesce(modifier(0), F.lit(0)))).otherwise(own)
    df = df.withColumn("role", role).withColumn("calibrated", level(adjusted))
    reason = (
        F.when(F.col("tier") == "universal", "universal_immutable")
        .when(region & (F.col("role") == "driving"), "region_sensitive_promoted")
        .when(region, "region_sensitive_demoted")
        .when(F.col("__same_match") >= BOILERPLATE, "boilerplate_repetition")
        .when(F.col("role") == "driving", "contextual_count_threshold")
        .when(F.col("role") == "supporting", "contextual_proximity_anchor")
        .otherwise("contextual_suppressed_default")
    )
    df = df.withColumn("reason", reason)
    drivers, total = F.count_if(F.col("role") == "driving").over(doc), F.count(F.lit(1)).over(doc)
    rescuable = (F.col("role") == "suppressed") & is_regulated(F.col("id"), F.col("type"))
    first = F.row_number().over(doc.orderBy(rescuable.desc(), own.desc(), "seq"))
    df = df.withColumn("__drivers", drivers).withColumn("__total", total).withColumn("__first", first)
    strong = (F.col("__total") == 1) & F.coalesce(F.col("id").isin(*STRONG), F.lit(False))
    rescued = (F.col("__drivers") == 0) & (strong | (rescuable & (F.col("__first") == 1)))
    df = df.withColumn("__rescued", rescued).withColumn("reason", F.when(F.col("__rescued"), F.when(strong, "single_strong_awareness").otherwise("regulated_rescue")).otherwise(F.col("reason")))
    df = df.withColumn("role", F.when(F.col("__rescued"), "driving").otherwise(F.col("role")))
    return df.drop("__same_id", "__same_match", "__near", "__drivers", "__total", "__first", "__rescued")
