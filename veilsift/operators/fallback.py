"""A second look at documents in which the rules found nothing, and the canary that proves the pipeline runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import prefilter
from ..functions.patterns import count_matches, java_regex
from . import gates

CARD = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
#: More e-mail addresses than these are a finding.
EMAILS = 5

# Structural fallbacks in order (description, type, severity, expression, flags); they read raw texts.
FALLBACKS = [
    ("SSN pattern detected", "pii", "critical", r"\b\d{3}-\d{2}-\d{4}\b", ""),
    ("Payment card pattern", "financial", "critical", CARD, ""),
    ("{count} email addresses", "pii", "medium", EMAIL, ""),
    ("API key pattern", "confidential", "critical", r"\b(sk-|pk_|api[_-]?key|bearer\s+[a-z0-9]+)", "i"),
    ("AWS access key", "confidential", "critical", r"AKIA[0-9A-Z]{16}", ""),
    ("Password detected", "confidential", "critical", r"password\s*[:=]\s*\S+", "i"),
]

prefilter.register(p for *_, p, _ in FALLBACKS)

# The canary's token and signal.
CANARY_TOKEN, CANARY_ID, CANARY_TYPE = "DETECTION_CANARY_123", "debug.canary", "debug-canary"


def hits(text: Column, guarded: bool = False) -> Column:
    """What the fallbacks find in a raw text: array of (seq, type, description, severity); guarded by the columns of ``prefilter.facts``.

    A card counts where any of a text's candidates passes the check digit and the issuer's prefix.
    Null and empty texts give nothing.
    """
    out = []
    for i, (description, kind, severity, pattern, flags) in enumerate(FALLBACKS):
        said: Column = F.lit(description)
        if pattern == CARD:
            # candidates only where the expression occurs at all
            holds = prefilter.holds(text, pattern, flags, guarded) & F.exists(F.regexp_extract_all(text, F.lit(java_regex(pattern)), F.lit(0)), gates.payment_card)
        elif pattern == EMAIL:
            n = count_matches(text, pattern, flags)
            holds = F.contains(text, F.lit("@")) & (n > EMAILS)
            said = F.concat(n.cast("string"), F.lit(description.removeprefix("{count}")))
        else:
            holds = prefilter.holds(text, pattern, flags, guarded)
        out.append(F.when(holds, F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("type"), said.alias("description"), F.lit(severity).alias("severity"))))
    return F.array_compact(F.array(*out))


def detect(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), source: str = "content") -> DataFrame:
    """``hits`` as rows: ``keep``, seq, type, description, severity, source; narrow."""
    rows = df.select(*keep, F.col(text_col).alias("__raw")).select(*keep, F.explode_outer(hits(F.col("__raw"))).alias("r")).where("r is not null")
    return rows.select(*keep, "r.*", F.lit(source).alias("source"))


def missed(docs: DataFrame, findings: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Fallback findings of the documents without a row in ``findings``.

    The anti join comes after the narrow scan: what it compares is the few fallback hits and the keys
    of the findings, so texts are never moved to find out which documents are left. Null keys equal each
    other, as they do in decisions.
    """
    weak = detect(docs, text_col, [key])
    known = findings.select(F.col(key).alias("__known"))
    return weak.join(known, weak[key].eqNullSafe(known["__known"]), "left_anti")


def unless_found(rows: DataFrame, primary: Column, key: str = "doc_id") -> DataFrame:
    """The same anti join where findings and fallbacks lie in one table already dealt out by document.

    ``primary`` is true for findings of the rules, false for fallbacks and null for others, which
    always stay. A window over the partitioning at hand needs no shuffle of its own and no second scan.
    """
    marked = rows.withColumn("__primary", primary).withColumn("__any", F.max("__primary").over(Window.partitionBy(key)))
    return marked.where(F.coalesce(F.col("__primary"), F.lit(True)) | ~F.coalesce("__any", F.lit(False))).drop("__primary", "__any")


def canary(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), source: str = "content") -> DataFrame:
    """A harmless signal where a text holds the canary's token, with the place of the first one in code points."""
    place = F.locate(CANARY_TOKEN, F.col("__raw")) - 1
    rows = df.select(*keep, F.col(text_col).alias("__raw")).where(F.contains("__raw", F.lit(CANARY_TOKEN)))
    return rows.select(*keep, F.lit(CANARY_ID).alias("id"), F.lit(CANARY_TYPE).alias("type"), F.lit("Debug canary signal detected").alias("description"), F.lit("low").alias("severity"), F.lit(source).alias("source"), place.alias("offset"), F.lit(CANARY_TOKEN).alias("match"))
