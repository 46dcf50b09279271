"""Operators on whole texts and names: locale scoring, dictionaries, destinations, chunks, markup, file signatures."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prefilter
from ..functions.patterns import count_matches, found, java_regex
from . import gates

# Domain endings by locale, in the order they are tried.
TLD_LOCALES = [(".us", "US"), (".gov", "US"), (".mil", "US"), (".uk", "UK"), (".co.uk", "UK"), (".dk", "EU-NORDICS"), (".no", "EU-NORDICS"), (".se", "EU-NORDICS"), (".fi", "EU-NORDICS"), (".is", "EU-NORDICS"), (".de", "EU-DACH"), (".at", "EU-DACH"), (".ch", "EU-DACH"), (".es", "EU-SOUTHERN"), (".it", "EU-SOUTHERN"), (".pt", "EU-SOUTHERN"), (".gr", "EU-SOUTHERN"), (".fr", "EU-WESTERN"), (".be", "EU-WESTERN"), (".nl", "EU-WESTERN"), (".lu", "EU-WESTERN"), (".pl", "EU-EASTERN"), (".cz", "EU-EASTERN"), (".sk", "EU-EASTERN"), (".hu", "EU-EASTERN"), (".ro", "EU-EASTERN"), (".bg", "EU-EASTERN"), (".ca", "EN-COMMONWEALTH"), (".au", "EN-COMMONWEALTH"), (".nz", "EN-COMMONWEALTH"), (".ie", "EN-COMMONWEALTH"), (".mx", "LATAM"), (".ar", "LATAM"), (".co", "LATAM"), (".cl", "LATAM"), (".pe", "LATAM"), (".br", "LATAM")]
# Currency marks and language markers by locale (pattern, flags).
CURRENCIES = {
    "US": [(r"\$\d+", ""), (r"USD", "i"), (r"\bUS\s*dollars?\b", "i")],
    "UK": [(r"£\d+", ""), (r"GBP", "i"), (r"\bpounds?\s*sterling\b", "i")],
    "EU-NORDICS": [(r"\b\d+\s*(kr|DKK|NOK|SEK)\b", "i"), (r"\bkroner?\b", "i")],
    "EU-DACH": [(r"€\d+", ""), (r"EUR", "i"), (r"\bCHF\b", "")],
    "EU-SOUTHERN": [(r"€\d+", ""), (r"EUR", "i")],
    "EU-WESTERN": [(r"€\d+", ""), (r"EUR", "i")],
    "EU-EASTERN": [(r"€\d+", ""), (r"EUR", "i"), (r"\bPLN\b", ""), (r"\bCZK\b", ""), (r"\bHUF\b", "")],
    "EN-COMMONWEALTH": [(r"\$\d+", ""), (r"CAD", "i"), (r"AUD", "i"), (r"NZD", "i")],
    "LATAM": [(r"\bMXN\b", ""), (r"\bARS\b", ""), (r"\bBRL\b", ""), (r"R\$\d+", "")],
}
LANGUAGES = {
    "US": [(r"\b(color|center|organization|realize)\b", "i")],
    "UK": [(r"\b(colour|centre|organisation|realise)\b", "i")],
    "EU-NORDICS": [(r"\b(og|eller|med|til|fra|af|på|for|den|det|de|en|et)\b", ""), (r"\b(och|eller|med|till|från|av|på|för|den|det|de|en|ett)\b", ""), (r"\b(moms|faktura|kvittering|bestilling|levering)\b", "i")],
    "EU-DACH": [(r"\b(und|oder|mit|zu|von|auf|für|der|die|das|ein|eine)\b", ""), (r"\b(Rechnung|Bestellung|Lieferung|MwSt)\b", "i")],
    "EU-SOUTHERN": [(r"\b(y|o|con|de|para|el|la|los|las|un|una)\b", ""), (r"\b(e|o|con|di|per|il|la|i|le|un|una)\b", "")],
    "EU-WESTERN": [(r"\b(et|ou|avec|de|pour|le|la|les|un|une)\b", ""), (r"\b(en|of|met|van|voor|de|het|een)\b", "")],
    "EU-EASTERN": [(r"\b(i|lub|z|do|dla|ten|ta|to)\b", "")],
    "EN-COMMONWEALTH": [(r"\b(colour|centre|organisation|realise|honour)\b", "i")],
    "LATAM": [(r"\b(y|o|con|de|para|el|la|los|las|un|una)\b", ""), (r"\b(e|ou|com|de|para|o|a|os|as|um|uma)\b", "")],
}
IBAN_LOCALES = {"DK": "EU-NORDICS", "NO": "EU-NORDICS", "SE": "EU-NORDICS", "FI": "EU-NORDICS", "DE": "EU-DACH", "AT": "EU-DACH", "CH": "EU-DACH", "ES": "EU-SOUTHERN", "IT": "EU-SOUTHERN", "PT": "EU-SOUTHERN", "GR": "EU-SOUTHERN", "FR": "EU-WESTERN", "BE": "EU-WESTERN", "NL": "EU-WESTERN", "LU": "EU-WESTERN", "PL": "EU-EASTERN", "CZ": "EU-EASTERN", "GB": "UK", "IE": "EN-COMMONWEALTH"}
IBAN_START = r"\b([A-Z]{2})\d{2}[A-Z0-9]{4,}"
LANGUAGE_TAGS = {"US": 0, "UK": 1}
PRIORITY = ["EU-NORDICS", "EU-DACH", "EU-WESTERN", "EU-SOUTHERN", "EU-EASTERN", "UK", "EN-COMMONWEALTH", "US", "LATAM"]


def _holds(text: Column, pattern: str, flags: str, guarded: bool) -> Column:
    """Whether the expression occurs; guarded, after the cheap conditions over the columns of ``prefilter.facts``."""
    return (prefilter.may_match(text, pattern, flags) & found(text, pattern, flags)) if guarded else found(text, pattern, flags)


#: Language markers of plain words, told apart by case: their expressions' words.
PLAIN_WORDS = {p: p[3:-3].split("|") for known in LANGUAGES.values() for p, f in known if not f and re.fullmatch(r"\\b\([^()]+\)\\b", p)}


def marker_words(text: Column) -> Column:
    """The words of PLAIN_WORDS that a text holds; it is split once for all of them."""
    known = sorted({w for words in PLAIN_WORDS.values() for w in words if w.isascii()})
    return F.array_intersect(F.array(*[F.lit(w) for w in known]), F.split(text, r"\W+"))


def _marked(text: Column, pattern: str, flags: str, words: Column | None) -> Column:
    """Whether a language marker occurs; with ``words``, plain words are looked up there."""
    if words is None or flags or pattern not in PLAIN_WORDS:
        return _holds(text, pattern, flags, words is not None)
    mark = F.arrays_overlap(words, F.array(*[F.lit(w) for w in PLAIN_WORDS[pattern] if w.isascii()]))
    for w in PLAIN_WORDS[pattern]:
        if not w.isascii():  # word boundaries are ASCII: these need their expression
            mark = mark | (F.contains(text, F.lit(w)) & found(text, rf"\b{w}\b"))
    return mark


def with_locale(df: DataFrame, text_col: str, url_col: str | None = None, language_col: str | None = None, guarded: bool = False) -> DataFrame:
    """Adds locale and locale_confidence; the winning score is a column of its own, read several times."""
    words = None
    if guarded:  # a column of its own, so that the split is not spelled again for each marker
        df, words = df.withColumn("__words", marker_words(F.col(text_col))), F.col("__words")
    best = best_locale(F.col(text_col), F.col(url_col) if url_col else None, F.col(language_col) if language_col else None, words)
    score, place = F.col("__best.score"), F.when(F.col("__best.score") > 0, F.col("__best.place")).otherwise("unknown")
    confidence = F.when(score >= 5, "high").when(score >= 3, "medium").when(score >= 1, "low").otherwise("none")
    return df.withColumn("__best", best).withColumns({"locale": place, "locale_confidence": confidence}).drop("__best", "__words")


def best_locale(text: Column, url: Column | None = None, language: Column | None = None, words: Column | None = None) -> Column:
    """The best (score, order, place) from a URL's domain ending, a language tag, currencies, language markers and an IBAN's country.

    A locale's language markers count two for each of its expressions that occurs, and only from two
    such expressions on (at most five points). Ties go by PRIORITY. The whole text counts. With ``words``, what
    ``marker_words`` tells, expressions run after the cheap conditions over the columns of ``prefilter.facts``.
    """
    guarded = words is not None
    iban = F.regexp_extract(text, java_regex(IBAN_START), 1)
    if guarded:
        iban = F.when(prefilter.may_match(text, IBAN_START), iban)
    tld = F.lit(None).cast("string")
    if url is not None:
        for end, place in reversed(TLD_LOCALES):
            tld = F.when(F.contains(url, F.lit(end)), place).otherwise(tld)
    tag = F.lower(F.coalesce(language, F.lit(""))) if language is not None else None
    starts = lambda *ps: F.substring(tag, 1, 2).isin(*ps)
    by_tag: dict[str, Column] = {}
    if tag is not None:
        by_tag = {
            "US": F.when(tag.startswith("en-us") | (tag == "en"), 2).otherwise(0),
            "UK": F.when(tag.startswith("en-gb"), 2).otherwise(0),
            "EU-NORDICS": F.when(starts("da", "no", "sv", "fi"), 2).otherwise(0),
            "EU-DACH": F.when(starts("de"), 2).otherwise(0),
            "EU-SOUTHERN": F.when(starts("es", "it", "pt"), 1).otherwise(0),
            "LATAM": F.when(starts("es", "it", "pt"), 1).otherwise(0),
            "EU-WESTERN": F.when(starts("fr", "nl"), 2).otherwise(0),
            "EU-EASTERN": F.when(starts("pl", "cs", "hu"), 2).otherwise(0),
        }
    scored = []
    for order, place in enumerate(PRIORITY):
        score = F.when(tld == place, 3).otherwise(0) if url is not None else F.lit(0)
        if guarded:
            money = reduce(lambda a, b: a | b, [_holds(text, p, f, guarded) for p, f in CURRENCIES[place]])
        else:  # one expression for all of a locale's currency marks
            money = text.rlike("|".join(f"(?{'iu' if 'i' in f else ''}:{java_regex(p)})" for p, f in CURRENCIES[place]))
        marks = [_marked(text, p, f, words) for p, f in LANGUAGES[place]]
        # a locale with one expression never gets its points; of two both must occur, so the second runs after the first only
        if len(marks) < 3:
            language = F.when(marks[0] & marks[1], 4).otherwise(0) if len(marks) == 2 else F.lit(0)
        else:
            language = F.get(F.array(*[F.lit(min(2 * n, 5) if n > 1 else 0) for n in range(len(marks) + 1)]), reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(False)).cast("int") for m in marks]))
        countries = [c for c, x in IBAN_LOCALES.items() if x == place]
        score = score + by_tag.get(place, F.lit(0)) + F.when(money, 2).otherwise(0) + language
        score = score + (F.when(iban.isin(*countries), 2).otherwise(0) if countries else F.lit(0))
        scored.append(F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(place).alias("place")))
    return F.array_max(F.array(*scored))


# Fixed values: (entry, label, values, severity, type, match) of the departments' dictionaries.
DICTIONARIES = {
    "finance": [
        ("finance-banking", "Banking details", ["bank account number", "routing number", "wire transfer", "swift code", "account balance"], "high", "financial", "phrase"),
        ("finance-confidential", "Confidential financial data", ["profit margin", "revenue forecast", "quarterly earnings", "budget allocation", "cost reduction"], "high", "financial", "phrase"),
        ("finance-transactions", "Transaction records", ["invoice", "purchase order", "payment receipt", "expense report"], "medium", "financial", "keyword"),
        ("finance-tax", "Tax information", ["tax return", "tax id", "ein number", "tax filing"], "high", "financial", "phrase"),
    ],
    "hr": [
        ("hr-medical", "Medical information", ["medical certificate", "health record", "diagnosis", "medical leave", "disability accommodation", "workers compensation"], "high", "pii", "phrase"),
        ("hr-compensation", "Compensation data", ["salary band", "compensation package", "bonus structure", "stock options", "pay grade"], "high", "sensitive", "phrase"),
        ("hr-performance", "Performance data", ["performance review", "performance improvement plan", "disciplinary action", "termination notice", "exit interview"], "medium", "sensitive", "phrase"),
        ("hr-recruiting", "Recruiting data", ["background check", "reference check", "offer letter", "employment contract"], "medium", "sensitive", "phrase"),
    ],
    "legal": [
        ("legal-privilege", "Privileged communication", ["attorney client privilege", "privileged and confidential", "work product doctrine", "legal hold"], "critical", "legal", "phrase"),
        ("legal-litigation", "Litigation matters", ["litigation hold", "settlement agreement", "court filing", "deposition transcript", "discovery request"], "high", "legal", "phrase"),
        ("legal-contracts", "Contract terms", ["non disclosure agreement", "non compete clause", "intellectual property assignment", "indemnification clause"], "medium", "legal", "phrase"),
        ("legal-regulatory", "Regulatory matters", ["regulatory filing", "compliance audit", "sec filing", "gdpr breach", "data breach notification"], "high", "legal", "phrase"),
    ],
}


def dictionary_hits(df: DataFrame, text_col: str = "text", department_col: str = "department", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each entry of the document's department that occurs: id, label, severity, type, hits."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(text_col)), java_regex(r"\s+"), " "))
    base = df.select(*keep, plain.alias("__t"), F.col(department_col).alias("__d"))
    rows = []
    for department, entries in DICTIONARIES.items():
        for name, label, values, severity, kind, match in entries:
            hits = F.lit(0)
            for v in values:
                n = count_matches(F.col("__t"), rf"\b{v}\b") if match == "keyword" else ((F.length("__t") - F.length(F.replace(F.col("__t"), F.lit(v), F.lit("")))) / len(v)).cast("int")
                hits = hits + n
            rows.append(F.when(F.col("__d") == department, F.struct(F.lit(name).alias("id"), F.lit(label).alias("label"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"), hits.cast("int").alias("hits"))))
    found_rows = base.select(*keep, F.explode_outer(F.filter(F.array(*rows), lambda r: r["hits"] > 0)).alias("r")).where("r is not null")
    return found_rows.select(*keep, "r.*")


# Hosts of public AI services, and of sign-in pages (a leading dot: any host below).
PUBLIC_AI = ["chatgpt.com", "chat.openai.com", "claude.ai", "gemini.google.com", "aistudio.google.com", "copilot.microsoft.com"]
AUTH_HOSTS = ["accounts.google.com", "login.microsoftonline.com", "login.live.com", ".okta.com", ".auth0.com"]


def destination(host: Column, internal: Sequence[str] = ()) -> Column:
    h = F.lower(F.coalesce(host, F.lit("")))
    auth = h.isin(*[a for a in AUTH_HOSTS if a[0] != "."])
    for a in AUTH_HOSTS:
        if a[0] == ".":
            auth = auth | h.endswith(a) | (h == a[1:])
    out = F.when(auth, "unknown")
    out = out.when(h.isin(*[i.lower() for i in internal]), "internal_ai") if internal else out
    return out.when(h.isin(*PUBLIC_AI), "public_ai").otherwise("unknown")


def matches_target(host: Column, target: Column, subdomains: bool = True) -> Column:
    h, t = F.lower(host), F.lower(target)
    return (h == t) | (F.lit(subdomains) & F.endswith(h, F.concat(F.lit("."), t)))


def first_target(hosts: DataFrame, targets: DataFrame, key: str, host_col: str = "host") -> DataFrame:
    """The first target (by ord) that each host is or lies below: equi-joins on the host's parent domains, no theta join."""
    labels = F.split(F.lower(F.col(host_col)), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    spread = hosts.select(key, F.explode(parents).alias("target"))
    hit = spread.join(F.broadcast(targets.select(F.lower("target").alias("target"), "ord")), "target")  # a configured list
    return hit.groupBy(key).agg(F.min_by("target", "ord").alias("target"))


def sanitized_host(text: Column) -> Column:
    """A plain lower-case host name from user input, or null."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^[a-z][a-z0-9+.-]*://", ""), r"[/?#:].*$", "")
    h = F.regexp_replace(F.regexp_replace(h, r"^\*\.", ""), r"\.$", "")
    return F.when((F.length(h) <= 253) & h.rlike(r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"), h)


CHUNK, OVERLAP = 32_768, 200


def chunks(df: DataFrame, text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Overlapping chunks with their absolute places: one row each; none for an empty text."""
    n = F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    rows = df.select(*keep, F.col(text_col).alias("__t"), F.explode(starts).alias("start"))
    return rows.select(*keep, "start", F.substring("__t", F.col("start") + 1, F.lit(size + overlap)).alias("chunk"))


# Rules of the chunk scan (id, type, severity, pattern, flags).
CHUNK_RULES = [
    ("pii.ssn", "pii", "critical", r"\b\d{3}-\d{2}-\d{4}\b", ""),
    ("financial.payment_card", "financial", "critical", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", ""),
    ("secret.api_key", "confidential", "critical", r"\b(sk-|pk_|api[_-]?key|bearer\s+[a-z0-9]+)", "i"),
    ("secret.aws_key", "confidential", "critical", r"AKIA[0-9A-Z]{16}", ""),
    ("secret.password", "confidential", "critical", r"password\s*[:=]\s*\S+", "i"),
    ("marker.confidential", "confidential", "high", r"\b(confidential|secret|classified|internal\s+only|restricted|proprietary)\b", "i"),
    ("financial.banking", "financial", "high", r"\b(bank\s+account|routing\s+number|swift|iban|wire\s+transfer)\b", "i"),
    ("legal.contract", "legal", "medium", r"\b(whereas|hereby|indemnify|liability|jurisdiction|arbitration|governing\s+law)\b", "i"),
    ("confidential.m_and_a", "confidential", "critical", r"\b(acquisition|merger|due\s+diligence|letter\s+of\s+intent|term\s+sheet|valuation)\b", "i"),
    ("pii.hr_data", "pii", "high", r"\b(salary|compensation|performance\s+review|termination|disciplinary)\b", "i"),
]


def all_matches(text: Column, pattern: str, flags: str = "") -> Column:
    """Every match with its place (code points from 0), by splitting the text at marked matches."""
    marked = F.split(F.regexp_replace(text, f"({java_regex(pattern, flags)})", "\u0001$0\u0001"), "\u0001")
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast("array<struct<place: int, matched: string>>").alias("found"))
    grown = lambda acc, piece: F.when(acc["odd"], F.concat(acc["found"], F.array(F.struct(acc["at"].alias("place"), piece.alias("matched"))))).otherwise(acc["found"])
    return F.aggregate(marked, zero, lambda acc, piece: F.struct((acc["at"] + F.length(piece)).alias("at"), (~acc["odd"]).alias("odd"), grown(acc, piece).alias("found")), lambda acc: acc["found"])


def _named(name: str, kind: str, severity: str) -> Callable[[Column], Column]:
    facts = [F.lit(name).alias("id"), F.lit(kind).alias("type"), F.lit(severity).alias("severity")]
    return lambda m: F.struct(*facts, m["place"].alias("place"), m["matched"].alias("matched"))


def chunk_scan(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """All matches of CHUNK_RULES in all chunks, each finding once: id, type, severity, offset, matched.

    Findings of the overlap between chunks have one id and offset, and count once.
    """
    return found_in_chunks(chunks(df, text_col, keep=keep), keep).dropDuplicates([*keep, "id", "offset"])


def found_in_chunks(parts: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """All matches of CHUNK_RULES in chunks (``keep``, start, chunk), by absolute offset; those of an overlap come twice."""
    rows = []
    for name, kind, severity, pattern, flags in CHUNK_RULES:
        hits = F.when(found(F.col("chunk"), pattern, flags), all_matches(F.col("chunk"), pattern, flags))
        rows.append(F.transform(hits, _named(name, kind, severity)))
    hits = parts.select(*keep, "start", F.explode_outer(F.flatten(F.array_compact(F.array(*rows)))).alias("m")).where("m is not null")
    hits = hits.select(*keep, "m.id", "m.type", "m.severity", (F.col("start") + F.col("m.place")).alias("offset"), "m.matched")
    card = F.col("id") != "financial.payment_card"
    return hits.where(card | gates.payment_card(F.col("matched")))


# Rules over file names (pattern, type, description, severity).
FILENAME_RULES = [
    (r"passport", "pii", "Passport document", "critical"),
    (r"ssn|social.?security", "pii", "Social Security Number", "critical"),
    (r"driver.?licen[sc]e", "pii", "Driver license", "high"),
    (r"birth.?cert", "pii", "Birth certificate", "high"),
    (r"tax.?return|w-?2|1099|w-?9", "financial", "Tax document", "critical"),
    (r"bank.?statement", "financial", "Bank statement", "high"),
    (r"invoice|payment|salary|payroll", "financial", "Financial document", "medium"),
    (r"budget|forecast|revenue", "financial", "Financial planning", "medium"),
    (r"confidential|secret|classified", "confidential", "Marked confidential", "critical"),
    (r"nda|non.?disclosure", "legal", "NDA/Legal agreement", "high"),
    (r"contract|agreement|terms", "legal", "Contract/Agreement", "medium"),
    (r"patent|trademark|copyright", "ip", "IP document", "high"),
    (r"proprietary|trade.?secret", "ip", "Proprietary information", "critical"),
    (r"employee|personnel|hr|human.?resource", "sensitive", "HR document", "medium"),
    (r"performance.?review|evaluation", "sensitive", "Employee evaluation", "high"),
    (r"medical|health|hipaa|diagnosis", "pii", "Health information", "critical"),
    (r"resume|cv|curriculum", "pii", "Resume/CV", "medium"),
    (r"\.env|credentials|api.?key|secret", "confidential", "Credentials file", "critical"),
    (r"private.?key|\.pem|\.key$", "confidential", "Private key", "critical"),
]


def filename_hits(name: Column) -> Column:
    """What a file's name says: array of (seq, type, description, severity)."""
    return F.array_compact(F.array(*[F.when(found(name, p, "i"), F.struct(F.lit(i).alias("seq"), F.lit(t).alias("type"), F.lit(d).alias("description"), F.lit(s).alias("severity"))) for i, (p, t, d, s) in enumerate(FILENAME_RULES)]))


def filename_signals(df: DataFrame, name_col: str = "filename", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    out = df.select(*keep, F.col(name_col).alias("__f")).select(*keep, F.explode_outer(filename_hits(F.col("__f"))).alias("r")).where("r is not null")
    return out.select(*keep, "r.*", F.lit("filename").alias("source"))


# Rules over document metadata (pattern, type, description, severity).
METADATA_RULES = [
    (r"confidential|secret|classified|internal.only|restricted", "confidential", "Confidentiality marker detected", "critical"),
    (r"legal|finance|hr|human.resource|accounting|payroll", "sensitive", "Sensitive department document", "high"),
    (r"merger|acquisition|deal|transaction|due.diligence|valuation|target", "confidential", "M&A/Deal information", "critical"),
    (r"employee|personnel|performance|salary|compensation|benefits", "pii", "Employee/HR data", "high"),
    (r"contract|agreement|nda|non.disclosure|terms|license", "legal", "Legal agreement", "high"),
    (r"budget|forecast|revenue|profit|loss|financial|quarterly|annual.report", "financial", "Financial information", "high"),
    (r"patent|invention|trademark|copyright|proprietary|trade.secret", "ip", "Intellectual property", "critical"),
]


def metadata_signals(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rules over the metadata fields joined by spaces (nulls and empty ones left out)."""
    whole = F.concat_ws(" ", *[F.when(F.col(f) != "", F.col(f)) for f in fields])
    rows = [F.when(found(F.col("__m"), p, "i"), F.struct(F.lit(i).alias("seq"), F.lit(t).alias("type"), F.lit(d).alias("description"), F.lit(s).alias("severity"))) for i, (p, t, d, s) in enumerate(METADATA_RULES)]
    out = df.select(*keep, whole.alias("__m")).select(*keep, F.explode_outer(F.array_compact(F.array(*rows))).alias("r")).where("r is not null")
    return out.select(*keep, "r.*", F.lit("metadata").alias("source"))


# Markers of receipts and orders; three make a text transactional.
TRANSACTIONAL = [
    (r"\b(kr|USD|EUR|GBP|DKK|SEK|NOK|\$|€|£)\b", 'i'),
    (r"\b\d+[.,]\d{2}\s*(kr|USD|EUR|GBP|DKK|SEK|NOK)?\b", 'i'),
    (r"\b(subtotal|total|moms|vat|tax|shipping|levering)\b", 'i'),
    (r"\b(order|ordre|invoice|faktura|receipt|kvittering|purchase|køb)\s*(number|nummer|#|no\.?)?\s*:?\s*\d+", 'i'),
    (r"\b(bestilling|transaction|betaling|payment)\b", 'i'),
    (r"\*{4}\s*\*{4}\s*\*{4}\s*\d{4}", ''),
    (r"\b(visa|mastercard|amex|dankort|mobilepay)\b", 'i'),
    (r"\b\d{3}\.\d{3}\.\d{2}\b", ''),
    (r"\b(sku|item|produkt|vare|artikel)\s*(number|nummer|#|no\.?)?\s*:?\s*[\w-]+", 'i'),
    (r"\b(delivery|levering|shipping|forsendelse|tracking)\b", 'i'),
    (r"\b(delivered|leveret|shipped|sendt)\b", 'i'),
]

prefilter.register(p for p, _ in TRANSACTIONAL)
prefilter.register(p for known in [*LANGUAGES.values(), *CURRENCIES.values()] for p, _ in known if p not in PLAIN_WORDS)


def is_transactional(text: Column, guarded: bool = False) -> Column:
    n = F.lit(0)
    for p, f in TRANSACTIONAL:
        n = n + _holds(text, p, f, guarded).cast("int")
    return F.coalesce((F.length(text) >= 50) & (n >= 3), F.lit(False))


def decode_entities(text: Column) -> Column:
    """The five named XML entities and decimal references below U+10000, in that order."""
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(name), F.lit(c))
    marked = F.split(F.regexp_replace(text, r"&#([0-9]{1,5});", "\u0001$1\u0001"), "\u0001")
    step = lambda acc, piece: F.struct(F.concat(acc["text"], F.when(acc["odd"], F.decode(F.unhex(F.lpad(F.hex(piece.cast("int")), 4, "0")), "UTF-16BE")).otherwise(piece)).alias("text"), (~acc["odd"]).alias("odd"))
    return F.aggregate(marked, F.struct(F.lit("").alias("text"), F.lit(False).alias("odd")), step, lambda acc: acc["text"])


def tag_texts(xml: Column, tag: str) -> Column:
    """Texts right inside each element of the tag, namespace prefix or not."""
    return F.regexp_extract_all(xml, F.lit(rf"(?i)<(?:\w+:)?{tag}(?:\s[^>]*)?>([^<]*)<"), F.lit(1))


def file_signature(content: Column, extension: Column) -> tuple[Column, Column, Column]:
    """(type, confidence, extension mismatch) from the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.when(F.length(content) < 4, "unknown").when(head == "D0CF11E0A1B11AE1", "ole2").when(head.startswith("504B0304"), "zip").when(head.startswith("25504446"), "pdf").otherwise("unknown")
    ext = F.lower(F.regexp_replace(extension, r"^\.", ""))
    expected = F.when(ext.isin("docx", "xlsx", "pptx"), "zip").when(ext.isin("doc", "xls", "ppt"), "ole2").when(ext == "pdf", "pdf")
    return kind, F.when(kind == "unknown", "low").otherwise("high"), F.coalesce((kind != "unknown") & (kind != expected), F.lit(False))


def evidence_window(text: Column, place: Column, length: Column) -> Column:
    """Up to 80 characters either side of a match, line ends as spaces, 220 characters at most."""
    start = F.greatest(place - 80, F.lit(0))
    return F.substring(F.regexp_replace(F.substring(text, start + 1, place + length + 80 - start), r"[\r\n]+", " "), 1, 220)


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters: cut at the last space if that is beyond half, else hard, then three dots."""
    cut = F.substring(text, 1, most - 3)
    last = F.length(cut) - F.locate(" ", F.reverse(cut))
    space = F.when(F.locate(" ", F.reverse(cut)) > 0, last).otherwise(-1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(space > (most - 3) * 0.5, F.substring(cut, F.lit(1), space)).otherwise(cut), F.lit("...")))


def activation(host: Column, targets: Sequence[str] = (), allowlist: bool = False, subdomains: bool = True, allow_empty: bool = False) -> tuple[Column, Column]:
    """(active, target): whether policy watches a host, and the first target that says so.

    Sign-in pages never are. Hybrid mode tries the built-in hosts, then the targets; an allowlist tries
    its targets alone, and while it is empty the built-in hosts, unless an empty list is meant.
    """
    h = F.lower(F.trim(F.coalesce(host, F.lit(""))))
    auth = h.isin(*[a for a in AUTH_HOSTS if a[0] != "."])
    for a in AUTH_HOSTS:
        if a[0] == ".":
            auth = auth | h.endswith(a) | (h == a[1:])
    own = [(t, False) for t in PUBLIC_AI]
    policy = [(t.lower(), subdomains) for t in targets]
    tried = (policy or ([] if allow_empty else own)) if allowlist else own + policy
    hit = F.lit(None).cast("string")
    for t, below in reversed(tried):
        hit = F.when((h == t) | (F.lit(below) & h.endswith(f".{t}")), t).otherwise(hit)
    hit = F.when((h == "") | auth, F.lit(None).cast("string")).otherwise(hit)
    return hit.isNotNull(), hit
