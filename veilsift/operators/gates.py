"""Gates: what a match must satisfy, beyond its expression, to count as a finding.

Each gate takes the match, the text and the match's place (code points from 0) as columns and gives
a boolean, or a confidence. All are Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checksums as cs
from ..functions.patterns import around, contains_any, found, java_regex, line_of
from ..plans import contexts

# Phrases before a confidentiality word that speak of the document itself.
SELF_REFERENCE = [
    r"\bthis\s+(?:document|information|report|email|communication|file|content|material|letter|memo|notice)\s+is\s+(?:strictly\s+)?",
    r"\bthe\s+following\s+(?:is|are)\s+",
    r"\bcontains?\s+(?:strictly\s+)?",
    r"\bmarked\s+(?:as\s+)?",
    r"\b(?:deemed|considered)\s+",
    r"\btreated\s+as\s+",
    r"\b(?:is|are)\s+privileged\s+and\s+",
    r"\battorney[\s-]*client\s+",
]
# Phrases of confidentiality policies.
POLICY_PHRASES = [
    r"\bdo\s+not\s+distribute\b",
    r"\bauthorized\s+personnel\s+only\b",
    r"\bfor\s+internal\s+use\s+only\b",
    r"\binternal\s+use\s+only\b",
    r"\brestricted\s+distribution\b",
    r"\bnot\s+for\s+public\s+release\b",
    r"\bproprietary\s+and\s+confidential\b",
    r"\bstrictly\s+confidential\b",
    r"\btop\s+secret\b",
    r"\bclassified\s+information\b",
    r"\bneed\s+to\s+know\b",
    r"\bnur\s+für\s+den\s+internen\s+gebrauch\b",
    r"\bstreng\s+vertraulich\b",
    r"\busage\s+interne\s+(uniquement|seulement)\b",
    r"\bne\s+pas\s+diffuser\b",
    r"\bkun\s+til\s+intern\s+brug\b",
    r"\bstrengt\s+fortroligt\b",
]
# Fixed value: medical vocabulary that makes an ICD-like code credible.
MEDICAL_TERMS = r"\b(patient|diagnosis|diagnosed|clinical|prescription|medication|prognosis|treatment|symptom|disease|disorder|syndrome|pathology|laboratory|specimen|physician|hospital|surgery|dosage|chronic|acute|comorbidity|medical\s+record|health\s+record|diagnostic|therapy|therapist|nurse|doctor|ailment|morbidity|biopsy|radiology|oncology|cardiology|neurology|pediatric|anesthesia|pharmacology|immunology|hematology|psychiatry|dermatology)\b"
# Syntax of PDF files, words of finance, and common words shaped like a bank code.
PDF_TOKENS = ["%PDF", "FlateDecode", "/Filter", "stream", "endstream", "endobj", "/Length", "/Type", "/Page", "/Font", "/Resources", "/Contents"]
FINANCE_WORDS = ["swift", "bic", "iban", "bank", "routing", "wire", "transfer", "payment", "account", "invoice", "sepa", "konto", "bankforbindelse", "bankverbindung", "kontonummer", "overforsel", "remittance", "beneficiary"]
COMMON_WORDS = ["DOCUMENT", "ARGUMENT", "JUDGMENT", "MOVEMENT", "FRAGMENT", "ORNAMENT", "MONUMENT", "BASEMENT", "ABSOLUTE", "INTEREST", "EVALUATE", "ESTIMATE", "COMBINED", "REQUIRED", "ACQUIRED", "PLATFORM", "UNDERSKRIFT", "JURISDICTIE"]


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def url_credentials(m: Column) -> Column:
    """A URL with credentials is noise when it spans lines or spaces, is over 200 characters, is mostly
    separators without a scheme, or hands a token to a loopback or test host."""
    dense = F.length(F.regexp_replace(m, "[a-zA-Z0-9]", "")) / F.length(m) > 0.45
    scheme = m.rlike("(?i)^https?://")
    inline = F.contains(F.regexp_extract(m, "(?i)^https?://([^/?#]+)", 1), F.lit("@"))
    host = F.lower(F.regexp_extract(m, "(?i)^https?://([^/?#:]+)", 1))
    local = m.rlike(r"(?i)^https?://\[::1\][/:?#]?") | host.isin("localhost", "127.0.0.1") | host.endswith(".local") | host.endswith(".test")
    marks = m.rlike(r":{2,}|/{3,}|@{2,}|[.]{4,}")
    token = m.rlike(r"(?i)[?&](token|secret|api_key|apikey)=[^&\s]{4,}")
    noise = found(m, r"[\r\n]") | found(F.regexp_replace(m, java_regex(r"^\s+|\s+$"), ""), r"\s") | (F.length(m) > 200) | (dense & ~scheme)
    return ~(noise | (~marks & scheme & ~inline & local & token))


def confidential_marker(m: Column, text: Column, place: Column) -> Column:
    """Whether a confidentiality word marks the document rather than being told of in prose."""
    size, total = F.length(m), F.length(text)
    line, at = line_of(text, place, size)
    before, after = F.substring(line, F.lit(1), at), F.substring(line, at + size + 1, F.length(line))
    lower = m == F.lower(m)
    capitals = (m == F.upper(m)) & m.rlike("[A-Z]")
    title = m.rlike("^[A-Z][a-z]*$") | found(m, r"^[A-Z][a-z]*\s+[A-Z][a-z]*")
    alone = found(F.concat(before, after), r"^\s*[-–—:]*\s*$")
    near_start, near_end = at <= 10, F.length(after) <= 10
    ratio = F.when(total > 0, place / total).otherwise(0.0)
    edge = (ratio < 0.05) | (ratio > 0.95)
    policy = found(around(text, place, size, 200), any_of(POLICY_PHRASES), "i")
    own = F.exists(F.array(*[F.lit(java_regex(p, "i")) for p in SELF_REFERENCE]), lambda p: F.regexp_like(F.substring(text, F.greatest(place - 60, F.lit(0)) + 1, F.least(place, F.lit(60))), p))
    prose = found(before, r"[a-zA-Z]{4,}\s*$") & found(after, r"^\s*[a-zA-Z]{4,}")
    telling = (F.length(line) > 40) | found(line, r"^\s*(the|a|an|this|that|our|my|your|their|it|its|some|many|most|few)\s+", "i")
    return (
        F.when(own | capitals | alone | policy | (edge & (near_start | near_end)), True)
        .when(lower & prose, False)
        .when(lower & ~edge & ~near_start, False)
        .when(title & ~prose, True)
        .when(lower & (near_start | near_end) & telling, False)
        .when(near_start | near_end, True)
        .otherwise(~lower)
    )


def medical_context(m: Column, text: Column, place: Column) -> Column:
    return found(around(text, place, F.length(m), 200), MEDICAL_TERMS, "i")


def issuer_prefix(digits: Column) -> Column:
    """Length and leading digits of the card schemes."""
    n = F.length(digits)
    lead = lambda k: F.substring(digits, 1, k).try_cast("int")
    return (
        (n.isin(13, 16, 19) & (lead(1) == 4))
        | ((n == 16) & (lead(2).between(51, 55) | lead(4).between(2221, 2720)))
        | ((n == 15) & lead(2).isin(34, 37))
        | (n.isin(16, 19) & ((lead(4) == 6011) | lead(3).between(644, 649) | (lead(2) == 65)))
        | (n.isin(14, 16) & (lead(3).between(300, 305) | lead(2).isin(36, 38, 39)))
        | (n.between(16, 19) & lead(4).between(3528, 3589))
    )


def payment_card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.length(digits).between(13, 19) & cs.luhn10(digits) & F.coalesce(issuer_prefix(digits), F.lit(False))


def country_codes() -> list[str]:
    """ISO 3166 codes as Java knows them, and Kosovo's user-assigned one."""
    from pyspark.sql import SparkSession

    return sorted({*SparkSession.active()._jvm.java.util.Locale.getISOCountries(), "XK"})


def swift_bic(m: Column, text: Column, place: Column) -> Column:
    near = lambda r: around(text, place, F.length(m), r)
    country = F.substring(m, 5, 2).isin(*country_codes()) & (F.length(m) >= 6)
    return country & ~contains_any(near(200), PDF_TOKENS) & ~F.upper(m).isin(*COMMON_WORDS) & contains_any(F.lower(near(80)), FINANCE_WORDS)


def proximity(m: Column, text: Column, place: Column, anchors: list[str], checksum: Column) -> Column:
    """Confidence from an anchor word within 100 characters and the checksum."""
    near = contains_any(F.lower(around(text, place, F.length(m), 100)), [a.lower() for a in anchors])
    return F.when(checksum, F.when(near, 0.99).otherwise(0.60)).otherwise(F.when(near, 0.40).otherwise(0.20))


def iban(m: Column, text: Column, place: Column) -> tuple[Column, Column]:
    good = cs.mod97_iban(F.regexp_replace(m, java_regex(r"\s+"), ""))
    return good, proximity(m, text, place, contexts.ANCHORS["iban"], F.lit(True))


def digit_boundary(m: Column, text: Column, place: Column) -> Column:
    """No digit right before or after the match."""
    before = F.when(place > 0, F.substring(text, place, F.lit(1))).otherwise("")
    after = F.substring(text, place + F.length(m) + 1, F.lit(1))
    return ~(before.rlike("[0-9]") | after.rlike("[0-9]"))


def _number(digits: Column, at: int, n: int = 2) -> Column:
    return F.substring(digits, at + 1, n).try_cast("int")


def _plausible(day: Column, month: Column, least_day: int = 1) -> Column:
    """Ranges only: no calendar."""
    return F.coalesce(day.between(least_day, 31) & month.between(1, 12), F.lit(False))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _of(value: Column, test: Callable[[Column], Column]) -> Column:
    """The test of a value that is worked out once: a check digit reads each of its characters, and would spell it anew for each."""
    return F.exists(F.array(value), test)


def _se(m: Column) -> Column:
    return _of(F.regexp_replace(m, java_regex(r"[-+\s]"), ""), _se_digits)


def _se_digits(d: Column) -> Column:
    long = F.length(d) >= 12
    short = F.when(long, F.substring(d, 3, 20)).otherwise(d)
    day = _number(short, 4)
    return _plausible(F.when(day.between(61, 91), day - 60).otherwise(day), _number(short, 2)) & (F.length(short) == 10) & cs.luhn10(short)


def _pesel(m: Column) -> Column:
    return _of(_digits(m), _pesel_digits)


def _pesel_digits(d: Column) -> Column:
    month = _number(d, 2)
    return cs.mod10_pl_pesel(d) & F.coalesce((month % 20).between(1, 12) & (month < 93), F.lit(False))


def _curp(m: Column) -> Column:
    u = F.upper(m)
    return u.rlike("^[A-Z]{4}[0-9]{6}[HM][A-Z]{5}[A-Z0-9][0-9]$") & _plausible(_number(u, 8), _number(u, 6))


def _rfc(m: Column) -> Column:
    u = F.regexp_replace(F.upper(m), java_regex(r"[\s-]"), "")
    date = F.regexp_extract(u, "^[A-ZÑ&]{3,4}([0-9]{6})[A-Z0-9]{3}$", 1)
    return (date != "") & _plausible(_number(date, 4), _number(date, 2), 0)


def _pps(m: Column) -> Column:
    u = F.regexp_replace(F.upper(m), java_regex(r"\s"), "")
    return _of(u, lambda u: u.rlike("^[0-9]{7}[A-W]{1,2}$") & cs.mod23_ie_pps(u))


def _cz(m: Column) -> Column:
    return _of(F.regexp_replace(m, java_regex(r"[\/\s]"), ""), _cz_digits)


def _cz_digits(d: Column) -> Column:
    month = _number(d, 2)
    return d.rlike("^[0-9]{10}$") & _plausible(_number(d, 4), F.when(month > 50, month - 50).otherwise(month)) & cs.mod11_cz_rc(d)


def _rut(m: Column, dots: bool) -> Column:
    u = F.regexp_replace(F.upper(m), java_regex(r"[.,\s]" if dots else r"\s"), "")
    return _of(u, lambda u: u.rlike("^[0-9]{7,8}-[0-9K]$") & cs.mod11_cl_rut(F.replace(u, F.lit("-"), F.lit(""))))


def _fnr(m: Column) -> Column:
    return _of(_digits(m), lambda d: _plausible(_number(d, 0), _number(d, 2)) & cs.mod11_no(d))


def _hetu(m: Column) -> Column:
    d = F.regexp_replace(m, "[-+A-Za-z]", "")
    return _plausible(_number(d, 0), _number(d, 2)) & cs.mod31_fi(m)


def _dated(check: Callable[[Column], Column], day: int, month: int) -> Callable[[Column], Column]:
    return lambda m: _of(_digits(m), lambda d: _plausible(_number(d, day), _number(d, month)) & check(d))


def _plain(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: _of(_digits(m), check)


def _nin(m: Column) -> Column:
    return F.regexp_replace(F.upper(m), java_regex(r"\s"), "").rlike("^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]$")


def _cuil(m: Column) -> Column:
    return _of(_digits(m), lambda d: _number(d, 0).isin(20, 23, 24, 27, 30, 33, 34) & cs.mod11_ar_cuil(d))


def _sin(m: Column) -> Column:
    return _of(_digits(m), lambda d: d.rlike("^[1-79][0-9]{8}$") & cs.luhn10(d))


class NationalId:
    """How one scheme's match is told valid: its own test, a clean digit boundary, a word that must be near."""

    def __init__(self, test: Callable[[Column], Column], anchors: str, boundary: bool = False, required: str = "", reach: int = 100, anchor_required: bool = False):
        self.test, self.anchors, self.boundary, self.required, self.reach, self.anchor_required = test, anchors, boundary, required, reach, anchor_required


NATIONAL_IDS: dict[str, NationalId] = {
    "global-dk-cpr": NationalId(lambda m: _plausible(_number(_digits(m), 0), _number(_digits(m), 2)), "dk_cpr", boundary=True),
    "global-se-personnummer": NationalId(_se, "se_personnummer", boundary=True),
    "global-no-fnr": NationalId(_fnr, "no_fnr", boundary=True),
    "global-fi-hetu": NationalId(_hetu, "fi_hetu", boundary=True),
    "global-de-steuer-id": NationalId(lambda m: _of(_digits(m), lambda d: cs.steuer_structure(d) & cs.mod1110_steuer(d)), "de_steuer_id", boundary=True, anchor_required=True),
    "global-es-dni-nie": NationalId(cs.mod23_es_dni, "es_dni_nie", boundary=True),
    "global-it-codice-fiscale": NationalId(cs.mod26_it_codice, "it_codice_fiscale", boundary=True),
    "global-pl-pesel": NationalId(_pesel, "pl_pesel", boundary=True, anchor_required=True),
    "global-nl-bsn": NationalId(_plain(cs.bsn11_test), "nl_bsn", boundary=True, anchor_required=True),
    "global-fr-nir": NationalId(cs.mod97_nir, "fr_nir", boundary=True),
    "global-pt-nif": NationalId(_plain(cs.mod11_nif), "pt_nif", boundary=True, anchor_required=True),
    "global-be-nn": NationalId(_dated(cs.mod97_be_nn, 4, 2), "be_nn"),
    "global-br-cpf": NationalId(_plain(cs.mod11_cpf), "br_cpf"),
    "global-br-cnpj": NationalId(_plain(cs.mod11_cnpj), "br_cnpj"),
    "global-mx-curp": NationalId(_curp, "mx_curp"),
    "global-mx-rfc": NationalId(_rfc, "mx_rfc", required="mx_rfc", reach=150),
    "global-ie-pps": NationalId(_pps, "ie_pps"),
    "global-at-sv-nr": NationalId(_dated(cs.mod10_at_sv_nr, 4, 6), "at_sv_nr", required="at_sv_nr"),
    "global-ro-cnp": NationalId(_dated(cs.mod11_ro_cnp, 5, 3), "ro_cnp"),
    "global-cz-rc": NationalId(_cz, "cz_rc"),
    "global-ar-cuil": NationalId(_cuil, "ar_cuil"),
    "global-cl-rut": NationalId(lambda m: _rut(m, True), "cl_rut"),
    "global-cl-rut-bare": NationalId(lambda m: _rut(m, False), "cl_rut", required="cl_rut"),
    "global-hu-taj": NationalId(_plain(cs.mod10_hu_taj), "hu_taj", required="hu_taj"),
    "global-uk-nin": NationalId(_nin, "uk_nin", required="uk_nin", reach=120),
    "global-au-tfn": NationalId(_plain(cs.mod11_au_tfn), "au_tfn", required="au_tfn"),
    "global-au-abn": NationalId(_plain(cs.mod89_au_abn), "au_abn", required="au_abn"),
    "global-ca-sin": NationalId(_sin, "ca_sin", required="ca_sin"),
}


def insurance_context(text: Column) -> Column:
    return contains_any(F.lower(text), contexts.INSURANCE)


def invoice_context(text: Column) -> Column:
    return found(text, any_of(contexts.INVOICE), "i")


def label_near(m: Column, text: Column, place: Column) -> Column:
    return contains_any(F.lower(around(text, place, F.length(m), 160)), contexts.LABELS)


def domain_adjusted(near: Column, confidence: Column) -> Column:
    """Halved near words of harmless numbers (which win), raised by a tenth near words of risky ones."""
    safe = contains_any(near, [a.lower() for a in contexts.ANCHORS["safe_domain"]])
    risky = contains_any(near, [a.lower() for a in contexts.ANCHORS["risky_domain"]])
    return F.when(safe, F.greatest(F.lit(0.10), confidence * 0.50)).when(risky, F.least(F.lit(0.99), confidence * 1.10)).otherwise(confidence)


def structured_lines(m: Column, text: Column, place: Column) -> Column:
    """The match's line and the line above, in lower case."""
    line, at = line_of(text, place, F.length(m))
    above = F.substring_index(F.substring(text, F.lit(1), place - at - 1), "\n", -1)
    return F.lower(F.concat(F.when(place > at, above).otherwise(""), F.lit("\n"), line))


def words_by_rule(lists: dict[int, list[str]]) -> Callable[[Column], Column]:
    """A rule number's list of words."""
    table = F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), F.array(*[F.lit(w.lower()) for w in v]))])
    return lambda seq: F.element_at(table, seq)


def national_id_columns(numbers: dict[str, int], seq: Column, m: Column, text: Column, place: Column) -> list[dict[str, Column]]:
    """Columns to add in turn to rows of national-id matches: the scheme's own test, and for what passes it windows, then facts, then ``__id_good`` and ``__id_confidence``.

    Rows carry the number of their rule, so windows and word lists are spelled once for all schemes.
    """
    size = F.length(m)
    chosen = {numbers[k]: v for k, v in NATIONAL_IDS.items() if k in numbers}
    anchors = words_by_rule({k: contexts.ANCHORS[v.anchors] for k, v in chosen.items()})
    reach = {r: [k for k, v in chosen.items() if v.required and v.reach == r] for r in (120, 150)}
    needed = F.when(seq.isin(*reach[120] or [-1]), around(text, place, size, 120)).when(seq.isin(*reach[150] or [-1]), around(text, place, size, 150)).otherwise(around(text, place, size, 100))
    windows = {"__near": F.lower(around(text, place, size, 100)), "__needed": F.lower(needed), "__labelled": label_near(m, text, place), "__lines": structured_lines(m, text, place)}
    test = F.lit(False)
    for k, v in chosen.items():
        test = F.when(seq == k, F.coalesce(v.test(m), F.lit(False))).otherwise(test)
    contained = lambda words, window: F.exists(words, lambda w: F.contains(window, w))
    bounded = [k for k, v in chosen.items() if v.boundary]
    required = {k: contexts.REQUIRED[v.required] for k, v in chosen.items() if v.required}
    checksum = ~seq.isin(*[k for k, v in chosen.items() if v.anchors == "dk_cpr"] or [-1]) | _of(_digits(m), cs.mod11_dk)
    anchored = contained(anchors(seq), F.col("__near"))
    score = F.when(checksum, F.when(anchored, 0.99).otherwise(0.60)).otherwise(F.when(anchored, 0.40).otherwise(0.20))
    tested = {"__test": test & (~seq.isin(*bounded or [-1]) | digit_boundary(m, text, place))}
    worded = {
        "__word": F.when(seq.isin(*required or [-1]), contained(words_by_rule(required)(seq), F.col("__needed"))).otherwise(True) if required else F.lit(True),
    }
    facts = {
        "__free": F.when(F.col("__word"), F.col("__labelled") | ~(insurance_context(text) | invoice_context(text))),
        "__id_confidence": domain_adjusted(F.col("__near"), score),
    }
    strict = [k for k, v in chosen.items() if v.anchor_required]
    sure = ~seq.isin(*strict or [-1]) | (F.col("__id_confidence") >= 0.65) | contained(anchors(seq), F.col("__lines"))
    # most matches fail the test, and what they stand among is not looked at
    guarded = [{k: F.when(F.col("__test"), v) for k, v in columns.items()} for columns in (windows, worded, facts)]
    return [tested, *guarded, {"__id_good": F.col("__test") & F.col("__word") & F.col("__free") & sure}]
