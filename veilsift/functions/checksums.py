"""Check-digit tests as Catalyst expressions: integer arithmetic on characters, no UDF.

Each function takes a string column and gives a boolean that is false, never null, for null or
malformed input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Position weights and check alphabets of the national schemes.
WEIGHTS = {
    "dk_cpr": [4, 3, 2, 7, 6, 5, 4, 3, 2, 1],
    "no_fnr_1": [3, 7, 6, 1, 8, 9, 4, 5, 2],
    "no_fnr_2": [5, 4, 3, 2, 7, 6, 5, 4, 3, 2],
    "nl_bsn": [9, 8, 7, 6, 5, 4, 3, 2, -1],
    "pt_nif": [9, 8, 7, 6, 5, 4, 3, 2],
    "br_cpf_1": [10, 9, 8, 7, 6, 5, 4, 3, 2],
    "br_cpf_2": [11, 10, 9, 8, 7, 6, 5, 4, 3, 2],
    "ie_pps": [8, 7, 6, 5, 4, 3, 2],
    "at_sv": [3, 7, 9, 0, 5, 8, 4, 2, 1, 6],
    "ro_cnp": [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9],
    "ar_cuil": [5, 4, 3, 2, 7, 6, 5, 4, 3, 2],
    "br_cnpj_1": [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2],
    "br_cnpj_2": [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2],
    "au_tfn": [1, 4, 3, 7, 5, 8, 6, 9, 10],
    "au_abn": [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19],
    "hu_taj": [3, 7, 3, 7, 3, 7, 3, 7],
    "cl_rut": [3, 2, 7, 6, 5, 4, 3, 2],
    "pl_pesel": [1, 3, 7, 9, 1, 3, 7, 9, 1, 3],
}
HETU_ALPHABET = "0123456789ABCDEFHJKLMNPRSTUVWXY"
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Values of 0-9 and A-Z at odd places of an Italian codice fiscale; digits equal the letters A-J.
CODICE_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def digit(c: Column, i: int) -> Column:
    """The digit at place i (from 0)."""
    return F.ascii(F.substring(c, i + 1, 1)) - 48


def weighted(c: Column, weights: Sequence[int]) -> Column:
    terms = [digit(c, i) * w for i, w in enumerate(weights) if w]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _where(format_ok: Column, test: Column) -> Column:
    return F.coalesce(F.when(format_ok, test), F.lit(False))


def _digits(c: Column, n: int) -> Column:
    return c.rlike(f"^[0-9]{{{n}}}$")


def _check(total: Column) -> Column:
    """11 minus the remainder by 11, with remainders 0 and 1 giving 0."""
    r = total % 11
    return F.when(r < 2, 0).otherwise(F.lit(11) - r)


def _same_digit(c: Column, n: int) -> Column:
    return c == F.repeat(F.substring(c, 1, 1), n)


def luhn10(c: Column) -> Column:
    return _where(c.rlike("^[0-9]+$"), F.call_function("luhn_check", c))


def mod11_dk(c: Column) -> Column:
    return _where(_digits(c, 10), weighted(c, WEIGHTS["dk_cpr"]) % 11 == 0)


def mod11_no(c: Column) -> Column:
    first, second = (F.lit(11) - weighted(c, WEIGHTS[k]) % 11 for k in ("no_fnr_1", "no_fnr_2"))
    good = lambda k, i: (k != 10) & (k % 11 == digit(c, i))
    return _where(_digits(c, 11), good(first, 9) & good(second, 10))


def mod31_fi(c: Column) -> Column:
    cleaned = F.when(F.substring(c, 7, 1).rlike("^[-+A-Y]$"), F.concat(F.substring(c, 1, 6), F.substring(c, 8, 100))).otherwise(c)
    number = F.substring(cleaned, 1, 9).try_cast("int")
    control = F.substring(F.lit(HETU_ALPHABET), number % 31 + 1, F.lit(1))
    return _where(cleaned.rlike("^[0-9]{9}[0-9A-Z]$"), control == F.substring(cleaned, 10, 1))


def mod1110_steuer(c: Column) -> Column:
    # as nested expressions the state would be spelled twice at each step; an aggregate keeps one
    places = F.array(*[F.lit(i) for i in range(1, 11)])
    step = lambda p, i: F.when((p + F.ascii(F.substring(c, i, F.lit(1))) - 48) % 10 == 0, 10).otherwise((p + F.ascii(F.substring(c, i, F.lit(1))) - 48) % 10) * 2 % 11
    state = F.aggregate(places, F.lit(0), step)
    return _where(c.rlike("^[1-9][0-9]{10}$"), (F.lit(11) - state) % 10 == digit(c, 10))


def mod97_nir(c: Column) -> Column:
    plain = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    corsica = F.substring(plain, 6, 2)
    number = F.concat(F.substring(plain, 1, 5), F.when(corsica == "2A", "19").when(corsica == "2B", "18").otherwise(corsica), F.substring(plain, 8, 20))
    payload, key = F.substring(number, 1, 13).try_cast("long"), F.substring(number, 14, 2).try_cast("int")
    return _where((F.length(plain) == 15) & _digits(number, 15), key == F.lit(97) - payload % 97)


def bsn11_test(c: Column) -> Column:
    total = weighted(c, WEIGHTS["nl_bsn"])
    return _where(_digits(c, 9), (total != 0) & (total % 11 == 0))


def mod11_nif(c: Column) -> Column:
    return _where(c.rlike("^[1-35-9][0-9]{8}$"), _check(weighted(c, WEIGHTS["pt_nif"])) == digit(c, 8))


def mod97_be_nn(c: Column) -> Column:
    payload, key = F.substring(c, 1, 9).try_cast("long"), F.substring(c, 10, 2).try_cast("int")
    before, after = F.lit(97) - payload % 97, F.lit(97) - (payload + 2_000_000_000) % 97
    return _where(_digits(c, 11), (key == before) | (key == after))


def mod11_cpf(c: Column) -> Column:
    good = (_check(weighted(c, WEIGHTS["br_cpf_1"])) == digit(c, 9)) & (_check(weighted(c, WEIGHTS["br_cpf_2"])) == digit(c, 10))
    return _where(_digits(c, 11) & ~_same_digit(c, 11), good)


def mod97_iban(c: Column) -> Column:
    plain = F.upper(F.regexp_replace(c, r"\s+", ""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda ch: F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, ch: F.when(ch == "", r).otherwise((r * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97))
    return _where(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}$"), rest == 1)


def mod23_ie_pps(c: Column) -> Column:
    plain = F.upper(F.regexp_replace(c, r"\s", ""))
    r = weighted(plain, WEIGHTS["ie_pps"]) % 23
    return _where(plain.rlike("^[0-9]{7}[A-W]"), F.ascii(F.substring(plain, 8, 1)) == F.when(r == 0, ord("W")).otherwise(r + 64))


def mod10_at_sv_nr(c: Column) -> Column:
    return _where(_digits(c, 10), weighted(c, WEIGHTS["at_sv"]) % 10 == digit(c, 3))


def mod11_ro_cnp(c: Column) -> Column:
    r = weighted(c, WEIGHTS["ro_cnp"]) % 11
    return _where(c.rlike("^[1-8][0-9]{12}$"), F.when(r == 10, 1).otherwise(r) == digit(c, 12))


def mod11_cz_rc(c: Column) -> Column:
    return _where(_digits(c, 10), c.try_cast("long") % 11 == 0)


def mod11_ar_cuil(c: Column) -> Column:
    r = weighted(c, WEIGHTS["ar_cuil"]) % 11
    return _where(_digits(c, 11), F.when(r == 0, 0).when(r == 1, 9).otherwise(F.lit(11) - r) == digit(c, 10))


def mod11_cnpj(c: Column) -> Column:
    good = (_check(weighted(c, WEIGHTS["br_cnpj_1"])) == digit(c, 12)) & (_check(weighted(c, WEIGHTS["br_cnpj_2"])) == digit(c, 13))
    return _where(_digits(c, 14) & ~_same_digit(c, 14), good)


def mod11_au_tfn(c: Column) -> Column:
    return _where(_digits(c, 9), weighted(c, WEIGHTS["au_tfn"]) % 11 == 0)


def mod89_au_abn(c: Column) -> Column:
    return _where(_digits(c, 11), (weighted(c, WEIGHTS["au_abn"]) - 10) % 89 == 0)


def mod10_hu_taj(c: Column) -> Column:
    return _where(_digits(c, 9), (F.lit(10) - weighted(c, WEIGHTS["hu_taj"]) % 10) % 10 == digit(c, 8))


def mod11_cl_rut(c: Column) -> Column:
    plain = F.upper(c)
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    turned = F.reverse(body)
    places = F.sequence(F.lit(0), F.length(turned) - 1)
    long = F.aggregate(places, F.lit(0), lambda s, i: s + (F.ascii(F.substring(turned, i + 1, F.lit(1))) - 48) * (i % 6 + 2))
    # numbers of the usual length are summed without a loop; zeros in front add nothing
    total = F.when(F.length(body) <= 8, weighted(F.lpad(body, 8, "0"), WEIGHTS["cl_rut"])).otherwise(long)
    expected = F.element_at(F.array(*[F.lit(c) for c in "K987654321"]), total % 11)
    return _where(plain.rlike("^[0-9]+[0-9K]$"), F.right(plain, F.lit(1)) == F.when(total % 11 == 0, "0").otherwise(expected))


def mod23_es_dni(c: Column) -> Column:
    """DNI or NIE: eight digits (X, Y, Z stand for 0, 1, 2 in front) and a letter."""
    plain = F.upper(F.regexp_replace(c, r"[\s.-]", ""))
    number = F.translate(F.substring(plain, 1, 8), "XYZ", "012")
    letter = F.substring(F.lit(DNI_LETTERS), number.try_cast("int") % 23 + 1, F.lit(1))
    return _where(plain.rlike("^[0-9XYZ][0-9]{7}[A-Z]$"), F.right(plain, F.lit(1)) == letter)


def mod26_it_codice(c: Column) -> Column:
    plain = F.upper(c)
    odd = F.array(*[F.lit(v) for v in CODICE_ODD])
    total = F.lit(0)
    for i in range(15):
        ch = F.substring(plain, i + 1, 1)
        place = F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 65)
        total = total + (F.element_at(odd, place + 1) if i % 2 == 0 else place)
    return _where(plain.rlike("^[A-Z0-9]{15}[A-Z]$"), F.ascii(F.substring(plain, 16, 1)) - 65 == total % 26)


def mod10_pl_pesel(c: Column) -> Column:
    return _where(_digits(c, 11), (F.lit(10) - weighted(c, WEIGHTS["pl_pesel"]) % 10) % 10 == digit(c, 10))


def steuer_structure(c: Column) -> Column:
    """Among the first ten digits exactly one value repeats (twice or three times)."""
    counts = [F.length(F.substring(c, 1, 10)) - F.length(F.replace(F.substring(c, 1, 10), F.lit(str(v)), F.lit(""))) for v in range(10)]
    repeated = sum((F.when(n >= 2, 1).otherwise(0) for n in counts), F.lit(0))
    return _where(_digits(c, 11), repeated == 1)


CHECKSUMS: dict[str, Callable[[Column], Column]] = {
    "luhn10": luhn10, "mod11_dk": mod11_dk, "mod11_no": mod11_no, "mod31_fi": mod31_fi, "mod1110_steuer": mod1110_steuer,
    "mod97_nir": mod97_nir, "bsn11_test": bsn11_test, "mod11_nif": mod11_nif, "mod97_be_nn": mod97_be_nn, "mod11_cpf": mod11_cpf,
    "mod97_iban": mod97_iban, "mod23_ie_pps": mod23_ie_pps, "mod10_at_sv_nr": mod10_at_sv_nr, "mod11_ro_cnp": mod11_ro_cnp,
    "mod11_cz_rc": mod11_cz_rc, "mod11_ar_cuil": mod11_ar_cuil, "mod11_cnpj": mod11_cnpj, "mod11_au_tfn": mod11_au_tfn,
    "mod89_au_abn": mod89_au_abn, "mod10_hu_taj": mod10_hu_taj, "mod11_cl_rut": mod11_cl_rut, "mod23_es_dni": mod23_es_dni,
    "mod26_it_codice": mod26_it_codice, "mod10_pl_pesel": mod10_pl_pesel, "steuer_structure": steuer_structure,
}
