"""Classes of documents whose text cannot be read, by the words of their names and metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import found
from ..plans import degraded_words as words

# Classes in the order they are tried, with severity and domain, and the note that goes with them.
CLASSES = [("doc.payroll", "critical", "payroll", words.PAYROLL), ("doc.hr_record", "critical", "hr_contract", words.HR), ("doc.insurance_policy", "high", "insurance", words.INSURANCE)]
DISCLAIMER = "This PDF could not be fully analyzed due to text readability limitations."
UNREADABLE = ["degraded", "blocked"]
#: What a caseless expression takes for s, i and k, and lower() does not: long s, dotless and dotted i, the Kelvin sign.
FOLDED = "\u017f\u0131\u0130\u212a"


def matching_form(text: Column) -> Column:
    """Lower case, hyphens and underscores as blanks, without the file's extension."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "-_", "  "), r"\.[a-z]{2,4}$", ""))


def tokens_of(vocabulary: dict[str, list[str]]) -> list[str]:
    return [w for language in vocabulary.values() for w in language]


def token_pattern(token: str) -> str:
    return rf"\b{re.escape(token).replace(chr(92) + ' ', ' ')}\b"


def matched_tokens(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The words of a vocabulary that a text in ``matching_form`` holds, in order, once for each language.

    A word's expression runs only where the word occurs at all, however its letters are cased.
    """
    bare = F.lower(F.translate(text, FOLDED, "siik"))
    # an array of one: the text is made once, not for each word
    each = lambda t: F.array_compact(F.array(*[F.when(F.contains(t["bare"], F.lit(w)) & found(t["text"], token_pattern(w), "i"), w) for w in tokens_of(vocabulary)]))
    return F.flatten(F.transform(F.array(F.struct(text.alias("text"), bare.alias("bare"))), each))


def classify(filename: Column, metadata: Column, quality: Column) -> Column:
    """(applied, document_class, severity, source, tokens, domain, disclaimer) by the quality of the extraction.

    Only degraded and blocked texts are placed; payroll goes before employment, that before insurance.
    ``source`` is filename, metadata or both. Null names and metadata are empty; ``metadata`` is title,
    subject and keywords in one text. Where nothing fits, severity is low and the rest null or empty.
    """
    name, more = (matching_form(F.coalesce(c, F.lit(""))) for c in (filename, metadata))
    none = F.struct(F.lit(False).alias("applied"), F.lit(None).cast("string").alias("document_class"), F.lit("low").alias("severity"), F.lit(None).cast("string").alias("source"), F.array().cast("array<string>").alias("tokens"), F.lit(None).cast("string").alias("domain"), F.lit("").alias("disclaimer"))

    def tried(f: Column) -> Column:
        return F.array(*[F.struct(F.lit(cls).alias("cls"), F.lit(severity).alias("severity"), F.lit(domain).alias("domain"), matched_tokens(f["name"], v).alias("own"), matched_tokens(f["more"], v).alias("other")) for cls, severity, domain, v in CLASSES])

    def row(c: Column) -> Column:
        source = F.when((F.size(c["own"]) > 0) & (F.size(c["other"]) > 0), "both").when(F.size(c["own"]) > 0, "filename").otherwise("metadata")
        return F.struct(F.lit(True).alias("applied"), c["cls"].alias("document_class"), c["severity"].alias("severity"), source.alias("source"), F.array_distinct(F.concat(c["own"], c["other"])).alias("tokens"), c["domain"].alias("domain"), F.lit(DISCLAIMER).alias("disclaimer"))

    # words of each class are looked for once; what reads them are functions of the classes that have any
    classes = F.flatten(F.transform(F.array(F.struct(name.alias("name"), more.alias("more"))), tried))
    rows = F.transform(F.filter(classes, lambda c: (F.size(c["own"]) > 0) | (F.size(c["other"]) > 0)), row)
    return F.when(F.coalesce(quality.isin(*UNREADABLE), F.lit(False)), F.coalesce(F.get(rows, F.lit(0)), none)).otherwise(none)
