"""Neighbourhoods of card candidates against windows cut out one by one."""

import random
import re

from veilsift.operators import cards


def plain(text):
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9_])\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}(?![A-Za-z0-9_])", text, re.A):
        a, b = m.span()
        around = text[max(0, a - 40) : a] + text[b : b + 40]
        letters, digits, spaces = (len(re.findall(p, around)) for p in ("[a-zA-Z]", "[0-9]", r"[\s]"))
        window = text[max(0, a - 100) : b + 100].lower()
        out.append((m[0], a, letters, digits, spaces, len(around) - letters - digits - spaces, any(w in window for w in cards.CARD_WORDS)))
    return out


def test_neighborhoods_against_windows():
    rng = random.Random(9)
    bits = ["4111 1111 1111 1111", "4111111111111112", "1234-5678-9012-3456", "12", "clause", "(7)", "card ", "Kreditkarte", "gültig bis", "é\U0001f600", "\n", " ", "x" * 30, "valid", " thru ", "99991111222233334444", "a4111111111111111"]
    for _ in range(300):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 60)))
        assert cards.neighborhoods(text) == plain(text), text
    assert cards.neighborhoods("") == [] and len(cards.neighborhoods("4111 1111 1111 1111 " * 1000)) == 1000


def test_awkward_rows_and_judgement(spark):
    docs = [(1, "card 4111 1111 1111 1111"), (2, None), (3, ""), (None, "4111 1111 1111 1111"), (4, "4111\n1111 1111 1111 and 4111111111111112"), (5, "1 2 3 4 5 6 7 8 9 4111-1111-1111-1111 9 8 7 6 5 4 3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "letters").selectExpr("letters AS doc_id", "text", "'clash' AS matched")
    rows = sorted(cards.validated(cards.candidates(df)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.place))
    assert [(r.doc_id, r.quality, r.valid, r.card_type, r.rejection) for r in rows] == [
        (1, "plausible", True, "visa", None), (4, "noise", True, "visa", None), (4, "plausible", False, None, "Failed Luhn checksum"), (5, "plausible", True, "visa", None), (None, "plausible", True, "visa", None),
    ]
    assert rows[0].context and not rows[1].context
    assert cards.candidates(df.limit(0)).count() == 0


def test_phones_by_locale(spark):
    from veilsift.operators import phones

    rows = [("US", "call 555-123-4567 or (555) 123-4567", ["555-123-4567", "(555) 123-4567"]), ("EU-NORDICS", "12 34 56 78, 4111 1111 1111 1111", ["12 34 56 78", "4111 1111", "1111 1111"]), (None, "5551234567", ["5551234567"]), ("XX", "5551234567", ["5551234567"]), ("UK", None, []), ("UK", "", [])]
    df = spark.createDataFrame(rows, "locale string, text string, want array<string>")
    assert all(r.phones == r.want and r.phone_count == len(r.want) for r in phones.with_phones(df).collect())
