import random
import re

import numpy as np

from veilsift.llm import graph, minhash, shingles

from .fixtures import SCHEMA, awkward, clashing, empty


def brute_sets(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def brute(rows, percent):
    """{doc_id: (n, component)} by comparing all pairs; rows with equal ids are one node."""
    sets = [(d, brute_sets(t)) for d, t in rows]
    top = {d: d for d, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return sorted((d, len(s), find(d) if s else d) for d, s in sets)


def near_copies(rng, base, n, rate):
    for _ in range(n):
        w = base.split(" ")
        for i in range(len(w)):
            if rng.random() < rate:
                w[i] = f"w{rng.randint(0, 10**6)}"
        yield " ".join(w)


def check(spark, rows, percent):
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, percent).collect())
    assert got == brute(rows, percent)


def test_against_all_pairs(spark):
    rng = random.Random(1)
    rows, at = [], 0
    for rate in (0.0, 0.004, 0.01, 0.016, 0.02, 0.03):
        base = " ".join(f"v{rng.randint(0, 5000)}" for _ in range(rng.choice([30, 80, 200])))
        for t in near_copies(rng, base, 30, rate):
            rows.append((at, t))
            at += 1
    rng.shuffle(rows)
    for percent in (80, 85):
        check(spark, rows, percent)


def test_tiles_split_a_bucket(spark, monkeypatch):
    """The driver's value of TILE sets how a bucket is cut, so a tiny one exercises pairs of tiles."""
    monkeypatch.setattr(minhash, "TILE", 4)
    rng = random.Random(2)
    base = " ".join(f"v{rng.randint(0, 5000)}" for _ in range(150))
    check(spark, list(enumerate(near_copies(rng, base, 60, 0.012))), 85)


def test_awkward_rows(spark):
    df = awkward(spark)
    out = {r.doc_id: r for r in minhash.near_duplicates(clashing(df), 85).collect() if r.doc_id is not None}
    assert out[2].component_id == 1 and not out[2].kept and out[3].component_id == 1 and out[1].kept
    assert out[5].n_shingles == out[6].n_shingles == out[7].n_shingles == 0
    assert out[5].component_id == 5 and out[6].component_id == 6
    assert out[9].component_id == 8 and out[8].n_shingles == 1
    assert minhash.near_duplicates(df, 85).count() == df.count()
    assert minhash.near_duplicates(empty(spark), 85).count() == 0
    kept = minhash.near_dedup(df, 85)
    assert kept.columns == df.columns and kept.where("doc_id = 13").count() == 2


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, shared in ((10, 8), (600, 480)):
        agree = 0
        for seed in range(40):
            pool = rng.integers(0, 2**63, n + (n - shared), dtype=np.uint64)
            s = shingles.sketches([np.unique(pool[:n]), np.unique(pool[n - shared :])], 252, seed)
            assert (s != 2**64 - 1).all()
            agree += (s[0] == s[1]).mean()
        true = shared / (2 * n - shared)
        assert abs(agree / 40 - true) < 0.05


def test_segments_do_not_change_words(monkeypatch):
    texts = [b"a bb  ccc\n" * 50, b"", b"z" * 500, b" q "]
    whole = shingles.words(texts)
    monkeypatch.setattr(shingles, "_SEGMENT", 7)
    for x, y in zip(whole, shingles.words(texts), strict=True):
        assert (x == y).all()


def test_band_rows_keep_the_promised_chance():
    for j in (0.8, 0.85, 0.9):
        r = minhash.band_rows(j)
        assert (1 - j**r) ** (minhash.COORDINATES // r) <= minhash.MISS


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5000 + i, 5001 + i) for i in range(60)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        top[q] = p
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_words_that_collide_modulo_a_power_of_two_stay_apart(spark):
    """Words of two letters in the order of Thue and Morse: every polynomial modulo 2**64 takes them for one."""
    first = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    second = first.translate(str.maketrans("ab", "ba"))
    hashes = [shingles.words([w.encode()])[0][0] for w in (first, second, first.upper(), first * 2, second * 2)]
    assert hashes[0] == hashes[2] and len(set(hashes)) == 4
    words = [f"w{i}" for i in range(6)]
    docs = [(1, " ".join([first, *words])), (2, " ".join([second, *words])), (3, first), (4, second)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
