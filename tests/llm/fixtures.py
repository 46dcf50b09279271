"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.replace(" ", "  ", 5), "en", "b"),
        (4, base + " tail", None, "b"),
        (5, None, "en", None),
        (6, "", "en", "a"),
        (7, " \n\t ", None, None),
        (8, "one two", "de", "c"),
        (9, "ONE  Two", "de", "c"),
        (10, prose(5000), "fr", "a"),
        (11, "x" * 30_000, "fr", "a"),
        (12, "naïve ŒUVRE \U0001f600 ʼs don't <|endoftext|> İ ſ ǅ\n\nσΣς", "fr", "a"),
        (13, "exactly five words right here", "en", "a"),
        (13, "exactly five words right here", "en", "a"),
        (None, base, "en", "a"),
        (None, None, None, None),
    ]
    rows += [(20 + i, "\n".join(prose(rng.randint(1, 60)) for _ in range(rng.randint(1, 6))), "en", "hot") for i in range(40)]
    return spark.createDataFrame([(d, t, l, s, None if t is None else len(t)) for d, t, l, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("h", "t", "sha", "node", "label", "key", "kept", "score", "length", "start", "good", "toxic", "sig", "unit", "bucket", "tokens", "topic", "t", "slot", "hot", "cell_0", "__log_weight", "__gumbel_key", "__kept", "__th", "__drop", "__dropped", "__topic", "__tokens", "__probability", "__error", "__cell_0", "__gone_id", "__kept_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df
