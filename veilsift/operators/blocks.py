"""What a reader is told beside a decision: concern, reason, confidence, a safer way; and how several files are shown together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .severity import rank

# Of each frame, the concern, why it matters, and a safer way.
FRAMES = {
    "FRAME_MEDICAL": ("Medical or health-related information", "Medical records contain protected health information that may be subject to privacy regulations.", "Ask your question without attaching the file, or share only the relevant excerpt."),
    "FRAME_PAYROLL": ("Payroll or compensation information", "Payroll files often contain salary details that are confidential between employees and HR.", "Remove salary figures or share only the portion relevant to your question."),
    "FRAME_HR": ("HR or employee records", "HR records typically contain personal information that may be protected by employment policy.", "Remove or redact identifying employee details before uploading."),
    "FRAME_LEGAL": ("Legal agreement content", "Legal documents may contain confidential terms or obligations affecting you or your organization.", "If you need AI help with this document, share just the relevant clause rather than the full file."),
    "FRAME_REGULATED_SENSITIVE": ("Government-issued identifier", "Government-issued identifiers can be used to verify identity and should be protected.", "Remove or redact the identifier before uploading."),
    "FRAME_PERSONAL_DATA_AWARENESS": ("Personal contact information", "Personal contact information may be subject to privacy laws in your region.", "Consider whether the contact details need to be included."),
    "FRAME_GENERAL_SENSITIVE": ("Sensitive document content", "Some of this content may not be intended for external sharing.", "Share only the relevant part, or ask without including the sensitive content."),
    "FRAME_PDF_UNREADABLE": ("Unknown content — document could not be fully read", "Text extraction was limited, so the full content of this file could not be assessed.", "Try exporting a text-readable version of the PDF and scan it before sharing."),
    "FRAME_INSURANCE": ("Insurance-related information", "Insurance documents may contain personal health or financial information.", "Share only the relevant policy section rather than the full document."),
    "FRAME_INVOICE": ("Invoice or receipt details (billing/payment)", "Invoices and receipts often contain billing, payment, or personal contact details.", "Share only the line items you need, or remove names, addresses, and payment details first."),
    "FRAME_HEALTH_CERTIFICATE": ("Health certificate details", "Health certificates often contain personal identifiers alongside health information.", "Share only the portion you need, or remove personal identifiers first."),
    "FRAME_COMPOSITE": ("Multiple sensitive content types", "This document contains multiple types of sensitive information that increase its overall sensitivity.", "Split the document and share only the section relevant to your question."),
    "FRAME_DISTRIBUTION_RESTRICTION": ("Distribution-restricted document", "This document contains language indicating it should not be redistributed.", "Ask without the attachment or describe the relevant parts instead."),
    "FRAME_DEGRADED_PAYROLL": ("Possible payroll information", "The document may contain salary or payment data that is typically confidential.", "Try exporting a text-readable PDF so the content can be assessed before sharing."),
    "FRAME_DEGRADED_HR": ("Possible HR records", "The document may contain employee records that are typically confidential.", "Try exporting a text-readable PDF so the content can be assessed before sharing."),
    "FRAME_DEGRADED_INSURANCE": ("Possible insurance information", "The document may contain insurance policy information.", "Try exporting a text-readable PDF so the content can be assessed before sharing."),
    "FRAME_REVIEW_ADVISED": ("Content that may warrant review", "This file could not be classified confidently. Review before sharing if unsure.", "Upload only the relevant section, or ask your question without the full attachment."),
    "FRAME_BUSINESS_SENSITIVE": ("Commercially sensitive information", "Business-sensitive content may include material non-public information that could affect transactions or negotiations.", "Remove or redact sensitive business terms before uploading, or ask without the attachment."),
    "FRAME_NOT_SCANNED": ("File not fully checked before sharing", "This file was not fully analyzed locally, so its contents could not be confirmed either way.", "Review the file yourself before sharing, or upload a smaller or text-readable version so it can be checked."),
}
GENERAL = "FRAME_GENERAL_SENSITIVE"
# Frames of limited analysis, frames that confirm, reasons that mean limits, and the three levels' texts.
LIMITED_FRAMES = ["FRAME_PDF_UNREADABLE", "FRAME_DEGRADED_PAYROLL", "FRAME_DEGRADED_HR", "FRAME_DEGRADED_INSURANCE", "FRAME_NOT_SCANNED"]
CONFIRMING_FRAMES = ["FRAME_MEDICAL", "FRAME_PAYROLL", "FRAME_REGULATED_SENSITIVE"]
LIMITED_REASONS = ["PDF_EXTRACTION_FAILED", "PDF_ENCRYPTED_PASSWORD_REQUIRED"]
DEFAULT_REASON = "FRAMES_DEFAULT_APPLIED"
CONFIDENCE = {
    "confirmed": ("Confirmed", "Multiple strong indicators support this assessment."),
    "inferred": ("Inferred", "Some indicators suggest this, but the evidence is mixed."),
    "limited_analysis": ("Reduced", "This file could not be fully read. The AI tool you’re uploading to may be able to read more than we could analyze."),
}


def display_confidence(frame: Column, severity: Column, details: Column, reasons: Column, limited: Column) -> Column:
    """confirmed, inferred or limited_analysis. ``details`` counts shown details; ``limited``: extraction failed or was partial."""
    frame, reasons = F.coalesce(frame, F.lit("")), F.coalesce(reasons, F.array().cast("array<string>"))
    cut = F.coalesce(limited, F.lit(False)) | frame.isin(*LIMITED_FRAMES) | F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in LIMITED_REASONS]))
    strong = severity.isin("high", "critical") & (frame.isin(*CONFIRMING_FRAMES) | ((details > 0) & ~F.array_contains(reasons, DEFAULT_REASON)))
    return F.when(cut, "limited_analysis").when(F.coalesce(strong, F.lit(False)), "confirmed").otherwise("inferred")


def quality_blocks(frame: Column, confidence: Column, title: Column, why: Column, action: Column) -> Column:
    """(primary_concern, why_this_matters, label, note, safer_option).

    ``title``, ``why`` and ``action`` are the leading signal's own texts; where null or empty, the frame's
    stand in, and for null or unknown frames the general one's.
    """
    known = F.create_map(*[x for k, v in FRAMES.items() for x in (F.lit(k), F.struct(*[F.lit(t).alias(n) for n, t in zip(("concern", "why", "safer"), v, strict=True)]))])
    level = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("label"), F.lit(v[1]).alias("note")))])
    own = lambda c: F.when(c != "", c)
    said = F.coalesce(F.element_at(known, F.coalesce(frame, F.lit(GENERAL))), F.element_at(known, F.lit(GENERAL)))
    at = F.element_at(level, confidence)
    return F.struct(
        F.coalesce(own(title), said["concern"]).alias("primary_concern"), F.coalesce(own(why), said["why"]).alias("why_this_matters"), at["label"].alias("label"), at["note"].alias("note"), F.coalesce(own(action), said["safer"]).alias("safer_option")
    )


def batch_visibility(decisions: DataFrame, batch_col: str) -> DataFrame:
    """One row a batch of files: interrupt if any file asks for it, else notice if any may be noticed, else interrupt.

    ``decisions`` has severity, escalation, visibility, signal_count and limited (null: false). A file asks where it was
    read in part or not at all, is medium at least, shows a signal, or is to be shown at once. Combines on the map side.
    """
    asks = F.coalesce("limited", F.lit(False)) | (rank(F.col("severity")) >= 2) | (F.col("signal_count") > 0) | (F.col("escalation") == "modal") | (F.col("visibility") == "interrupt")
    grouped = decisions.groupBy(batch_col).agg(F.coalesce(F.bool_or(asks), F.lit(False)).alias("asks"), F.coalesce(F.bool_or(F.col("visibility") == "notice"), F.lit(False)).alias("may"), F.count(F.lit(1)).alias("files"))
    return grouped.select(batch_col, "files", F.when(~F.col("asks") & F.col("may"), "notice").otherwise("interrupt").alias("visibility"))
