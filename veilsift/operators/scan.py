"""The detection scan: every rule over every text, as columns of one row rather than a cross join."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prefilter
from ..functions.patterns import count_matches, first_match, found, java_regex, place_of, strings
from ..plans.rules import RULES, Rule
from . import gates

# Which rules have which gate.
URL_RULES = {"global-url-credentials", "global-url-query-credentials"}
CONFIDENTIAL_RULES = {"global-confidential-en", "global-confidential-de", "global-confidential-fr", "global-confidential-es", "global-confidential-nordic", "english-gov-clearance", "romance-confidential", "nordic-confidential"}
CARD_RULES = {"global-credit-card", "registry-credit-card-spaced"}
SWIFT_RULES = {"global-swift"}
IBAN_RULES = {"global-iban"}
ICD_RULES = {"registry-icd10-code"}
NATIONAL_ID = "global-national-id"

# Function words that tell a language.
ENGLISH_WORDS = ["the", "and", "for", "that", "with", "this", "from", "are", "was", "not", "but", "have", "has", "been", "were", "will", "can", "its", "your", "their", "which", "would", "should", "could", "into", "than", "other", "these", "those", "each", "does", "did", "about", "between"]
NORDIC_WORDS = ["og", "er", "den", "det", "til", "med", "som", "har", "kan", "vil", "ikke", "eller", "fra", "ved", "der", "alle", "blev", "skal", "efter", "også", "kun", "sig", "samt", "hvis", "mere", "sin", "sit", "sine", "hans", "hele"]

SEVERITIES = ["none", "low", "medium", "high", "critical"]
CONFIDENCES = ["low", "medium", "high"]
#: Language packs in use by default, and the locale confidence they ask for.
DEFAULT_PACKS = ("global", "english", "nordic")

SIGNAL = "seq int, id string, pattern_id string, type string, severity string, description string, source string, n int, matched string, place int, confidence double"


def plain_words(text: Column) -> Column:
    """The words of the first 5000 characters in lower case, without the marks around them."""
    cleaned = F.regexp_replace(F.substring(text, 1, 5000), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F�]", " ")
    parts = F.filter(F.split(F.lower(cleaned), java_regex(r"\s+")), lambda w: w != "")
    return F.transform(parts, lambda w: F.ltrim(F.rtrim(w, F.lit(".,;:!?)'\"")), F.lit("'\"(")))


def function_word_density(words: Column, known: list[str]) -> Column:
    """At least 30 words, of which 8 different function words and 3 % at all."""
    enough = lambda hits: (F.size(F.array_distinct(hits)) >= 8) & (F.size(hits) / F.size(words) >= 0.03)
    return (F.size(words) >= 30) & F.exists(F.array(F.filter(words, lambda w: w.isin(*known))), enough)


def locale_confidence(text: Column, language: Column | None = None) -> Column:
    """0 low, 1 medium, 2 high: from a language tag, else from function words of texts from 200 characters on."""
    # an array of one: a text is split once for both languages
    either = lambda words: function_word_density(words, ENGLISH_WORDS) | function_word_density(words, NORDIC_WORDS)
    dense = (F.length(text) >= 200) & F.exists(F.array(plain_words(text)), either)
    by_text = F.when(dense, 1).otherwise(0)
    if language is None:
        return by_text
    return F.when(language.rlike("(?i)^[a-z]{2}-[A-Z]{2}$"), 2).when(F.coalesce(language, F.lit("")) != "", 1).otherwise(by_text)


def _gated(rule: Rule) -> bool:
    return rule.id in URL_RULES | CONFIDENTIAL_RULES | CARD_RULES | SWIFT_RULES | IBAN_RULES or rule.id in gates.NATIONAL_IDS


def active_rules(packs: Iterable[str] = DEFAULT_PACKS, disabled: Iterable[str] = ()) -> list[Rule]:
    chosen, off = set(packs), set(disabled)
    return [r for r in RULES if r.pack in chosen and r.id not in off]


def _icd_count(text: Column, rule: Rule) -> Column:
    """Matches with medical words within 200 characters, each match by its own window."""
    pattern = java_regex(rule.regex, rule.flags)
    marked = F.split(F.regexp_replace(text, f"({pattern})", "\u0001$0\u0001"), "\u0001")
    # odd pieces are the matches; a running length gives each one's place
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.lit(0).alias("n"))
    near = lambda acc, piece: acc["odd"] & F.coalesce(gates.medical_context(piece, text, acc["at"]), F.lit(False))
    step = lambda acc, piece: F.struct((acc["at"] + F.length(piece)).alias("at"), (~acc["odd"]).alias("odd"), (acc["n"] + F.when(near(acc, piece), 1).otherwise(0)).alias("n"))
    return F.aggregate(marked, zero, step, lambda acc: acc["n"])


def scan(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text_norm", language_col: str | None = None, source: str = "content", keep: Iterable[str] = ("doc_id",), beside: Column | None = None) -> DataFrame:
    """One row a signal: the ``keep`` columns and the fields of SIGNAL.

    Rules become columns of a single projection (a plan as narrow as the table), and only findings
    become rows. A gated rule tests its first match only. Rules of language packs count where the
    text's locale confidence is medium at least. Null texts give no signals. ``beside``, an array of SIGNAL,
    is what else was found in a row: it comes out as it is, so one pass reads the text for all.
    """
    rules = active_rules() if rules is None else rules
    keep = list(keep)
    text = F.col("__text")
    more = [] if beside is None else ["__beside"]
    base = df.select(*keep, F.col(text_col).alias("__text"), *([F.col(language_col).alias("__language")] if language_col else []), *([beside.alias("__beside")] if more else []))
    # only what these rules ask for: without literals no text goes to Python
    among = prefilter.conditions_of(r.regex for r in rules)
    base = base.withColumns(prefilter.facts(text, among))
    mays = [prefilter.may_match(text, r.regex, r.flags, among) for r in rules]
    # words are counted where a rule of a language pack may match
    asked = reduce(lambda a, b: a | b, [m for m, r in zip(mays, rules, strict=True) if r.pack != "global"], F.lit(False))
    base = base.withColumn("__locale", F.when(asked, locale_confidence(text, F.col("__language") if language_col else None)).otherwise(0))
    hits = []
    for i, (r, may) in enumerate(zip(rules, mays, strict=True)):
        matched, n = F.lit(None).cast("string"), F.lit(1)
        if r.pack != "global":
            may = may & (F.col("__locale") >= 1)
        if _gated(r):
            matched = first_match(text, r.regex, r.flags)
            hits.append(F.when(may, _hit(i, F.lit(1), matched)))
        elif r.id in ICD_RULES:
            hits.append(F.when(may & found(text, r.regex, r.flags), _hit(i, _icd_count(text, r), matched)))
        elif r.min_count:
            hits.append(F.when(may, _hit(i, count_matches(text, r.regex, r.flags), matched)))
        else:
            hits.append(F.when(may & found(text, r.regex, r.flags), _hit(i, n, matched)))
    least = F.array(*[F.lit(max(1, r.min_count)) for r in rules])
    is_gated = [i for i, r in enumerate(rules) if _gated(r)]
    good = lambda h: h.isNotNull() & (h["n"] >= F.element_at(least, h["seq"] + 1)) & (~h["seq"].isin(*is_gated or [-1]) | h["matched"].isNotNull())
    # an outer explode: the optimizer would put the whole array into a filter below an inner one
    passed = F.filter(F.array(*hits), good)
    if more:
        # one element without a rule, which no gate looks at, carries what was found beside the rules
        none = F.struct(F.lit(None).cast("int").alias("seq"), F.lit(1).alias("n"), F.lit(None).cast("string").alias("matched"))
        passed = F.concat(passed, F.when(F.size("__beside") > 0, F.array(none)).otherwise(F.array().cast("array<struct<seq: int, n: int, matched: string>>")))
    rows = base.select(*keep, *more, "__text", F.explode_outer(passed).alias("__hit")).where("__hit is not null")
    if not more:
        return _judged(rows.select(*keep, "__text", "__hit.*"), rules, source, keep)
    judged = _judged(rows.select(*keep, *more, "__text", "__hit.*"), rules, source, [*keep, *more])
    own = F.array(F.struct(*[F.col(c).cast(t).alias(c) for c, t in (f.split() for f in SIGNAL.split(", "))]))
    each = F.when(F.col("seq").isNull(), F.col("__beside")).otherwise(own)
    return judged.select(*keep, F.explode_outer(each).alias("__s")).where("__s is not null").select(*keep, "__s.*")


def _hit(i: int, n: Column, matched: Column) -> Column:
    return F.struct(F.lit(i).alias("seq"), n.cast("int").alias("n"), matched.alias("matched"))


def _judged(rows: DataFrame, rules: list[Rule], source: str, keep: list[str]) -> DataFrame:
    """Gates over rows of matches; the text is carried only along the few that matched."""
    text, seq, m, p = F.col("__text"), F.col("seq"), F.col("matched"), F.col("place")
    at = lambda ids: [i for i, r in enumerate(rules) if r.id in ids]
    pattern = F.element_at(strings(java_regex(r.regex, r.flags) for r in rules), seq + 1)
    rows = rows.withColumn("place", F.when(m.isNotNull(), place_of(text, pattern)).cast("int"))
    numbers = {r.id: i for i, r in enumerate(rules) if r.id in gates.NATIONAL_IDS}
    for columns in gates.national_id_columns(numbers, seq, m, text, p) if numbers else ():
        is_id = seq.isin(*numbers.values())
        rows = rows.withColumns({k: F.when(is_id, v) for k, v in columns.items()})
    # only the gates of rules that are there: a plan with all of them is too large for the JVM to compile
    kinds = [(URL_RULES, lambda: gates.url_credentials(m)), (CONFIDENTIAL_RULES, lambda: gates.confidential_marker(m, text, p)), (CARD_RULES, lambda: gates.payment_card(m)), (SWIFT_RULES, lambda: gates.swift_bic(m, text, p)), (IBAN_RULES, lambda: gates.iban(m, text, p)[0])]
    good = F.when(m.isNull(), True)
    for ids, gate in kinds:
        if at(ids):
            good = good.when(seq.isin(*at(ids)), gate())
    good = good.otherwise(F.col("__id_good") if numbers else F.lit(True))
    confidence = F.when(seq.isin(*at(IBAN_RULES)), gates.iban(m, text, p)[1]) if at(IBAN_RULES) else F.when(F.lit(False), F.lit(0.0))
    if numbers:
        confidence = confidence.when(seq.isin(*numbers.values()), F.col("__id_confidence"))
    spelled = [(r.count_text.split("{count}") if r.count_text else ["", f" {r.name}"]) if r.min_count else None for r in rules]
    facts = [(NATIONAL_ID if r.id in numbers else r.id, r.id, r.type, r.severity, s[0] if s else r.description, s[1] if s else "", bool(s)) for r, s in zip(rules, spelled, strict=True)]
    names = ("id", "pattern_id", "type", "severity", "before", "after", "counted")
    table = F.from_json(F.lit(json.dumps([dict(zip(names, f, strict=True)) for f in facts])), "array<struct<id: string, pattern_id: string, type: string, severity: string, before: string, after: string, counted: boolean>>")
    rule = F.element_at(table, seq + 1)
    # likewise an outer explode, where a filter would be pushed below the columns it reads and spell them again
    rows = rows.withColumn("__rule", rule).withColumn("confidence", confidence)
    rows = rows.withColumn("__good", F.explode_outer(F.when(good, F.array(F.lit(1))))).where("__good is not null")
    description = F.when(F.col("__rule.counted"), F.concat(F.col("__rule.before"), F.col("n").cast("string"), F.col("__rule.after"))).otherwise(F.col("__rule.before"))
    return rows.select(*keep, "seq", "__rule.id", "__rule.pattern_id", "__rule.type", "__rule.severity", description.alias("description"), F.lit(source).alias("source"), "n", "matched", "place", "confidence")
