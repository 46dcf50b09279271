"""Queries over numbers derived from ``orders``: each check-digit test, and each identifier's gate."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums as cs

Query = Callable[[SparkSession, str], DataFrame]

# How each test's input is spelled from a number x: runs of n digits of it, and fixed or picked characters.
# d7: seven digits; a letter list in brackets picks by x.
SHAPES: dict[str, list[str]] = {
    "luhn10": ["d16"], "mod11_dk": ["d10"], "mod11_no": ["d11"], "mod31_fi": ["d6", "-", "d3", f"[{cs.HETU_ALPHABET}]"], "mod1110_steuer": ["d11"],
    "mod97_nir": ["d15"], "bsn11_test": ["d9"], "mod11_nif": ["d9"], "mod97_be_nn": ["d11"], "mod11_cpf": ["d11"],
    "mod97_iban": ["DE", "d20"], "mod23_ie_pps": ["d7", "[ABCDEFGHIJKLMNOPQRSTUVW]"], "mod10_at_sv_nr": ["d10"], "mod11_ro_cnp": ["d13"],
    "mod11_cz_rc": ["d10"], "mod11_ar_cuil": ["d11"], "mod11_cnpj": ["d14"], "mod11_au_tfn": ["d9"],
    "mod89_au_abn": ["d11"], "mod10_hu_taj": ["d9"], "mod11_cl_rut": ["d8", "[0123456789K]"], "mod23_es_dni": ["d8", f"[{cs.DNI_LETTERS}]"],
    "mod26_it_codice": ["RSSMRA", "d2", "[ABCDEHLMPRST]", "d2", "[FGH]", "d3", "[ABCDEFGHIJKLMNOPQRSTUVWXYZ]"], "mod10_pl_pesel": ["d11"], "steuer_structure": ["d11"],
}
PRIMES = [7919, 104729, 1299709, 15485863, 32452843, 49979687, 67867967]


def spelled(shape: list[str]):
    """The input as a Spark column over o_orderkey."""
    parts = []
    for k, piece in enumerate(shape):
        x = F.col("o_orderkey").cast("decimal(38,0)") * PRIMES[k % 7] * 1_000_003 + k
        if piece[0] == "d" and piece[1:].isdigit():
            n = int(piece[1:])
            parts.append(F.lpad((x % F.lit(Decimal(10**n))).cast("decimal(38,0)").cast("string"), n, "0"))
        elif piece[0] == "[":
            parts.append(F.substring(F.lit(piece[1:-1]), (x % len(piece[1:-1])).cast("int") + 1, F.lit(1)))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def spelled_sql(shape: list[str]) -> str:
    parts = []
    for k, piece in enumerate(shape):
        x = f"(o_orderkey::hugeint * {PRIMES[k % 7]} * 1000003 + {k})"
        if piece[0] == "d" and piece[1:].isdigit():
            n = int(piece[1:])
            parts.append(f"lpad(({x} % {10**n})::varchar, {n}, '0')")
        elif piece[0] == "[":
            parts.append(f"substr('{piece[1:-1]}', ({x} % {len(piece[1:-1])})::int + 1, 1)")
        else:
            parts.append(f"'{piece}'")
    return " || ".join(parts)


def _d(i: int, s: str = "s") -> str:
    return f"(ascii(substr({s}, {i + 1}, 1)) - 48)"


def _w(name: str, s: str = "s") -> str:
    return "(" + " + ".join(f"{_d(i, s)} * {w}" for i, w in enumerate(cs.WEIGHTS[name]) if w) + ")"


def _c(total: str) -> str:
    return f"(CASE WHEN {total} % 11 < 2 THEN 0 ELSE 11 - {total} % 11 END)"


def _luhn() -> str:
    return "(list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * (ascii(substr(s, length(s) - i + 1, 1)) - 48) > 9 THEN 2 * (ascii(substr(s, length(s) - i + 1, 1)) - 48) - 9 ELSE 2 * (ascii(substr(s, length(s) - i + 1, 1)) - 48) END ELSE ascii(substr(s, length(s) - i + 1, 1)) - 48 END)) % 10 = 0)"


SQL: dict[str, str] = {
    "luhn10": _luhn(),
    "mod11_dk": f"{_w('dk_cpr')} % 11 = 0",
    "mod11_no": f"(11 - {_w('no_fnr_1')} % 11) <> 10 AND (11 - {_w('no_fnr_1')} % 11) % 11 = {_d(9)} AND (11 - {_w('no_fnr_2')} % 11) <> 10 AND (11 - {_w('no_fnr_2')} % 11) % 11 = {_d(10)}",
    "mod31_fi": f"substr('{cs.HETU_ALPHABET}', (substr(s, 1, 6) || substr(s, 8, 3))::bigint::int % 31 + 1, 1) = substr(s, 11, 1)",
    "mod1110_steuer": f"substr(s, 1, 1) <> '0' AND (11 - list_reduce([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], lambda p, i: (CASE WHEN (p + ascii(substr(s, i, 1)) - 48) % 10 = 0 THEN 10 ELSE (p + ascii(substr(s, i, 1)) - 48) % 10 END) * 2 % 11)) % 10 = {_d(10)}",
    "mod97_nir": "substr(s, 14, 2)::int = 97 - substr(s, 1, 13)::bigint % 97",
    "bsn11_test": f"{_w('nl_bsn')} <> 0 AND {_w('nl_bsn')} % 11 = 0",
    "mod11_nif": f"substr(s, 1, 1) NOT IN ('0', '4') AND {_c(_w('pt_nif'))} = {_d(8)}",
    "mod97_be_nn": "substr(s, 10, 2)::int = 97 - substr(s, 1, 9)::bigint % 97 OR substr(s, 10, 2)::int = 97 - (2000000000 + substr(s, 1, 9)::bigint) % 97",
    "mod11_cpf": f"s <> repeat(substr(s, 1, 1), 11) AND {_c(_w('br_cpf_1'))} = {_d(9)} AND {_c(_w('br_cpf_2'))} = {_d(10)}",
    "mod97_iban": "(substr(s, 5) || '1314' || substr(s, 3, 2))::hugeint % 97 = 1",
    "mod23_ie_pps": f"ascii(substr(s, 8, 1)) = CASE WHEN {_w('ie_pps')} % 23 = 0 THEN 87 ELSE 64 + {_w('ie_pps')} % 23 END",
    "mod10_at_sv_nr": f"{_w('at_sv')} % 10 = {_d(3)}",
    "mod11_ro_cnp": f"{_d(0)} BETWEEN 1 AND 8 AND (CASE WHEN {_w('ro_cnp')} % 11 = 10 THEN 1 ELSE {_w('ro_cnp')} % 11 END) = {_d(12)}",
    "mod11_cz_rc": "s::bigint % 11 = 0",
    "mod11_ar_cuil": f"(CASE {_w('ar_cuil')} % 11 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 11 - {_w('ar_cuil')} % 11 END) = {_d(10)}",
    "mod11_cnpj": f"s <> repeat(substr(s, 1, 1), 14) AND {_c(_w('br_cnpj_1'))} = {_d(12)} AND {_c(_w('br_cnpj_2'))} = {_d(13)}",
    "mod11_au_tfn": f"{_w('au_tfn')} % 11 = 0",
    "mod89_au_abn": f"({_w('au_abn')} - 10) % 89 = 0",
    "mod10_hu_taj": f"(10 - {_w('hu_taj')} % 10) % 10 = {_d(8)}",
    "mod11_cl_rut": "substr(s, 9, 1) = (SELECT CASE k WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE k::varchar END FROM (SELECT 11 - " + "(" + " + ".join(f"{_d(7 - i)} * {i % 6 + 2}" for i in range(8)) + ") % 11 AS k))",
    "mod23_es_dni": f"substr(s, 9, 1) = substr('{cs.DNI_LETTERS}', substr(s, 1, 8)::int % 23 + 1, 1)",
    "mod26_it_codice": "ascii(substr(s, 16, 1)) - 65 = (" + " + ".join((f"[{', '.join(map(str, cs.CODICE_ODD))}]" if i % 2 == 0 else "") + (f"[CASE WHEN substr(s, {i + 1}, 1) BETWEEN '0' AND '9' THEN ascii(substr(s, {i + 1}, 1)) - 48 ELSE ascii(substr(s, {i + 1}, 1)) - 65 END + 1]" if i % 2 == 0 else f"(CASE WHEN substr(s, {i + 1}, 1) BETWEEN '0' AND '9' THEN ascii(substr(s, {i + 1}, 1)) - 48 ELSE ascii(substr(s, {i + 1}, 1)) - 65 END)") for i in range(15)) + ") % 26",
    "mod10_pl_pesel": f"(10 - {_w('pl_pesel')} % 10) % 10 = {_d(10)}",
    "steuer_structure": "list_sum(list_transform(range(0, 10), lambda v: CASE WHEN 10 - length(replace(substr(s, 1, 10), v::varchar, '')) >= 2 THEN 1 ELSE 0 END)) = 1",
}


def _query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        numbers = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", spelled(SHAPES[name]).alias("digits"))
        return numbers.select("o_orderkey", "digits", cs.CHECKSUMS[name](F.col("digits")).alias("valid"))

    return run


def queries() -> dict[str, Query]:
    return {f"cksum_{name}": _query(name) for name in cs.CHECKSUMS}


def oracle_sql() -> dict[str, str]:
    return {f"cksum_{n}": f"SELECT o_orderkey, s AS digits, {SQL[n]} AS valid FROM (SELECT o_orderkey, {spelled_sql(SHAPES[n])} AS s FROM orders)" for n in cs.CHECKSUMS}
