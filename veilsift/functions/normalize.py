"""Text normalization before detection: Catalyst expressions, and Arrow UDFs for what they can't say."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udf
from pyspark.sql.types import StringType

from .patterns import java_regex

# Words near which spaced digits belong to an identifier, how near, and the least lengths.
ID_ANCHORS = [
    (r"\bCPR\b", "i"),
    (r"\bCPR[-\s]*nr\.?\b", "i"),
    (r"(?<!\p{L})Fødselsdato(?!\p{L})", "iu"),
    (r"(?<!\p{L})cpr[-\s]*nummer(?!\p{L})", "iu"),
    (r"\bPersonnummer\b", "i"),
    (r"\bPersonnr\.?\b", "i"),
    (r"\bsamordningsnummer\b", "i"),
    (r"(?<!\p{L})Fødselsnummer(?!\p{L})", "iu"),
    (r"(?<!\p{L})Fodselsnummer(?!\p{L})", "iu"),
    (r"\bfnr\.?\b", "i"),
    (r"\bDNI\b", "i"),
    (r"\bNIE\b", "i"),
    (r"\bNIF\b", "i"),
    (r"\bRUT\b", "i"),
    (r"\bCURP\b", "i"),
    (r"\bRFC\b", "i"),
    (r"\bNational\s*ID\b", "i"),
    (r"\bID[-\s]*nummer\b", "i"),
]
ANCHOR_REACH = 120
LEAST_LETTERS = 6
LEAST_DIGITS = 6

# Fixed value: zero-width and direction marks.
ZERO_WIDTH = r"[\u200B-\u200F\u2060\uFEFF\u00AD\u202A-\u202E\u2066-\u2069]"

#: ECMAScript's white space and line ends.
_TRIM = "\t\n\x0b\x0c\r \u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def unify_hyphens(text: Column) -> Column:
    for c in "\u2010\u2011\u2012\u2013":
        text = F.replace(text, F.lit(c), F.lit("-"))
    return text


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", " ")


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def repair_hyphenation(text: Column) -> Column:
    """Join a word cut by a hyphen at a line's end, unless an upper-case letter stands before the hyphen."""
    return F.regexp_replace(text, r"([\p{L}&&[^\p{Lu}\p{Lt}]])[-\u2010-\u2014\u2212\u00AD] ?\r?\n(\p{Ll})", "$1$2")


def collapse_white_space(text: Column) -> Column:
    """One space for runs of spaces and tabs, one line feed for runs of line ends, lines and text trimmed."""
    one = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # expressions match only where they change something, and lines are trimmed from their ends inwards
    spaced = F.regexp_replace(F.replace(one, F.lit("\t"), F.lit(" ")), "  +", " ")
    lines = F.transform(F.split(F.regexp_replace(spaced, "\n\n+", "\n"), "\n"), trim)
    return trim(F.array_join(lines, "\n"))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_TRIM))


def nfkc(text: Column) -> Column:
    """NFKC; plain ASCII texts are their own and do not go to Python."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfkc(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)))


@pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


_SPACED = regex.compile(rf"(?<!\p{{L}})\p{{L}}(?: \p{{L}}(?!\p{{L}})){{{LEAST_LETTERS - 1},}}")
_SPACED_DIGITS = regex.compile(r"[0-9](?:\s+[0-9])+(?:\s*-\s*[0-9](?:\s+[0-9])+)?")
_ANCHORS = [regex.compile(p, regex.IGNORECASE | (0 if "u" in f else regex.ASCII)) for p, f in ID_ANCHORS]


def join_letters(text: str) -> str:
    """Single letters with one space between them become a word, from six on, line by line."""
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), text)


def join_digits(text: str) -> str:
    """Six or more spaced digits near an identifier's word lose their spaces."""
    if len(text) < 10:
        return text
    spots = sorted({p for a in _ANCHORS for m in a.finditer(text) for p in m.span()})

    def join(m: regex.Match) -> str:
        close = any(0 <= m.start() - p <= ANCHOR_REACH or 0 <= p - m.end() <= ANCHOR_REACH for p in spots)
        if sum(c.isdigit() for c in m[0]) < LEAST_DIGITS or not close:
            return m[0]
        return regex.sub(r"\s*-\s*", "-", regex.sub(r"(?<=[0-9])\s+(?=[0-9])", "", m[0]))

    return _SPACED_DIGITS.sub(join, text) if spots else text


@pandas_udf(StringType())
def _join(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else join_digits(join_letters(t)))


def has_spaced(text: Column) -> Column:
    return text.rlike(java_regex(r"\p{L}(?: \p{L}(?!\p{L})){5}|[0-9](?:\s+[0-9])(?:[\s-]+[0-9]){4}"))


def normalized(df: DataFrame, text_col: str = "text", out_col: str = "text_norm") -> DataFrame:
    """``df`` with the text after the whole sequence of steps.

    What later stages read more than once comes out of an explode of one element, which the optimizer does not look
    through: a plain column beside a Python UDF it would spell anew, with all stages before, for every use.
    """
    df = df.withColumn("__compatible", nfkc(F.col(text_col)))
    df = df.withColumn("__plain", once(collapse_white_space(repair_hyphenation(strip_zero_width(strip_controls(unify_hyphens(F.col("__compatible"))))))))
    df = df.withColumn("__spaced", once(F.when(has_spaced(F.col("__plain")), F.col("__plain"))))
    # only texts that have spaced runs go to Python
    joined = F.when(F.col("__spaced").isNotNull(), _join("__spaced")).otherwise(F.col("__plain"))
    return df.withColumn(out_col, once(joined)).drop("__compatible", "__plain", "__spaced")


def once(value: Column) -> Column:
    """The value as the optimizer cannot look through it: filters and further uses read it, they do not spell it again."""
    return F.explode_outer(F.array(value))


# Words and marks near which a European number is money, how near.
MONEY_WORDS = [
    "DKK", "EUR", "SEK", "NOK", "USD", "GBP", "CHF", "PLN", "amount", "total", "sum", "vat", "invoice", "price", "cost", "payment", "balance",
    "salary", "net", "gross", "saldo", "moms", "faktura", "pris", "betaling", "brutto", "netto", "betrag", "gesamtbetrag", "summe", "rechnungsbetrag",
    "zahlbetrag", "iban", "bic", "kontoinhaber", "bankverbindung", "verwendungszweck", "mwst", "ust", "gehalt", "lohn", "abrechnung",
    "gehaltsabrechnung", "lohnabrechnung", "bruttogehalt", "nettogehalt",
]
MONEY_MARKS = [r"\bkr\.?\b", "€", r"\$", "£"]
MONEY_WORDS_UNICODE = ["beløb", "lön", "løn"]
MONEY_REACH = 120

_MONEY = [regex.compile(rf"\b(?:{'|'.join(MONEY_WORDS)})\b", regex.I | regex.A), *(regex.compile(p, regex.I | regex.A) for p in MONEY_MARKS), regex.compile(rf"(?<!\p{{L}})(?:{'|'.join(MONEY_WORDS_UNICODE)})(?!\p{{L}})", regex.I)]
_EU_NUMBER = regex.compile(r"([0-9]{1,3}(?:[\s.][0-9]{3})*),([0-9]{2})(?![A-Za-z0-9_])")


def shadow_of(text: str) -> str | None:
    """The text with European numbers near money words in plain form (90 500,00 as 90500.00); None if none is."""
    spots = [p for a in _MONEY for m in a.finditer(text) for p in m.span()] if len(text) >= 10 else []
    if not spots:
        return None
    changed = False

    def plain(m: regex.Match) -> str:
        nonlocal changed
        if not any(0 <= m.start() - p <= MONEY_REACH or 0 <= p - m.end() <= MONEY_REACH for p in spots):
            return m[0]
        changed = True
        return regex.sub(r"[\s.]", "", m[1]) + "." + m[2]

    out = _EU_NUMBER.sub(plain, text)
    return out if changed else None


@udf(StringType(), useArrow=False)
def _shadow(text: str | None) -> str | None:
    """Row by row, a hundred texts a batch: Arrow's batches of 10,000 hold up to 64 MB of texts, several times over in a worker."""
    return None if text is None else shadow_of(text)


def numeric_shadow(text: Column) -> Column:
    """shadow_of for a column; only texts with a European number go to Python."""
    return _shadow(F.when(text.rlike(r"[0-9],[0-9]{2}"), text))
