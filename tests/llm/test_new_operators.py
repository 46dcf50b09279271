"""Byte-level BPE, ranked search and the filter audit against libraries, plain spellings and their SQL."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veilsift.llm import byte_bpe, filter_audit, lexical, queries, shingles

from .fixtures import awkward, clashing, empty

RANKS_FILE, PATTERN = byte_bpe.default_ranks()


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS_FILE, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- byte-level BPE -----------------------------------------------------------------------------------


def test_pairs_encode_like_the_library(ranks, library):
    own = byte_bpe.BytePairs(ranks, PATTERN, room=200)
    rng = random.Random(3)
    chars = [chr(c) for c in range(0x2000)] + list("   \n\t\r'''sSmMdDlLrRveEtT!.,<|>0123456789") * 20 + ["漢", "字", "\U0001f600", "‍", " ", "̈"]
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(own.encode(text), np.int32).tolist()
        assert ids == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_pieces_where_longest_matches_fail(ranks, library):
    """Random strings over few letters make the search take tokens back; single bytes and long runs go, too."""
    own = byte_bpe.BytePairs(ranks, PATTERN)
    rng = random.Random(4)
    for _ in range(2000):
        piece = "".join(rng.choice(rng.choice(("ab", "ing", "thersion", "aeiou"))) for _ in range(rng.randint(1, 60)))
        assert own.encode_piece(piece.encode()).tolist() == library.encode_ordinary(piece), piece
    for data in (bytes([b]) for b in range(256)):
        assert own.decode(own.encode_piece(data)) == data
    long = "x" * 30_000 + "".join(rng.choice("abc") for _ in range(30_000))
    assert own.encode_piece(long.encode()).tolist() == library.encode_ordinary(long)
    assert not own.encode_piece(b"")


def test_every_token_encodes_as_the_library_does(ranks, library):
    own = byte_bpe.BytePairs(ranks, PATTERN)
    for token in itertools.islice(ranks, 0, None, 97):
        assert own.encode_piece(token).tolist() == [ranks[token]]
        assert byte_bpe.merged(token, ranks) == [token] or len(byte_bpe.merged(token, ranks)) > 1


def test_a_vocabulary_whose_tokens_cannot_be_reached():
    """'bc' is never merged in 'abc' since 'ab' comes first; alone it is a token of its own."""
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abcc": 5}
    own = byte_bpe.BytePairs(ranks, PATTERN)
    assert own.encode_piece(b"abc").tolist() == [3, 2]
    assert own.encode_piece(b"bc").tolist() == [4]
    assert own.encode_piece(b"abcc").tolist() == [5]  # a whole piece that is a token is that token
    assert own.encode_piece(b"abccb").tolist() == [3, 2, 2, 1]  # 'abcc' cannot be merged
    with pytest.raises(ValueError):
        own.encode_piece(b"ad")


def test_bpe_query_on_documents_and_awkward_rows(spark, sf_dir, documents, library):
    def check(docs, rows):
        want = []
        for r in docs.collect():
            ids = library.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(rows, key=repr) == sorted(want, key=repr)

    check(documents, [tuple(r) for r in queries.op11_byte_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()])
    odd = awkward(spark)
    got = byte_bpe.decode(byte_bpe.encode(clashing(odd))).collect()
    check(odd, [(r.doc_id, len(r.ids), hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(bytes(r.decoded)).hexdigest()) for r in got])
    assert byte_bpe.decode(byte_bpe.encode(empty(spark))).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded == b""


# --- ranked search --------------------------------------------------------------------------------------


def plain_cuts(impacts, widest, price):
    best, back = [0], [0]
    for j in range(1, len(impacts) + 1):
        cost, length = min((best[j - m] + m * max(impacts[j - m : j]) + price, m) for m in range(1, min(widest, j) + 1))
        best.append(cost)
        back.append(length)
    return best[-1]


def test_blocks_have_the_least_cost():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 7, 0, 40, 200, 3, 40])
    impacts = rng.integers(1, 1000, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    for widest, price in ((8, 500), (64, 3000), (64, 0)):
        owner, ends = lexical.block_ends(impacts, starts, lengths, widest, price)
        for i, n in enumerate(lengths):
            cuts = ends[owner == i].tolist()
            assert (cuts[-1] if cuts else 0) == n and cuts == sorted(set(cuts))
            mine = impacts[starts[i] : starts[i] + n].tolist()
            cost = sum((b - a) * max(mine[a:b]) + price for a, b in zip([0, *cuts], cuts, strict=False))
            assert all(b - a <= widest for a, b in zip([0, *cuts], cuts, strict=False))
            assert cost == plain_cuts(mine, widest, price)


def plain_search(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, Counter(cut(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, size = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 10 + 90 * c.total() * n // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(cut(text)) if c[w])
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(item, i + 1, d if real else None, -s) for i, (s, real, d) in enumerate(sorted(scores)[:k])]
    return out


def test_search_is_exact_over_shards(spark):
    """Few words make many ties; shards of a few documents, rounds and item blocks of all sizes agree."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.randint(0, 30)))) for i in range(400)]
    docs += [(None, "w1 W2 w3"), (400, None), (401, " ;"), (402, "w5 " * 5000), (402, "w5 w6")]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(20)] + [(90, None), (91, "nowhere"), (92, "W1 w1-w1"), (None, "w7")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items)
    for size, pairs in ((1 << 20, 1000), (50, 1000), (1, 30)):
        index = lexical.build_index(frame, shard_postings=size)
        got = [tuple(r) for r in lexical.search(index, asked, pairs=pairs).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_blocks_are_skipped():
    """Where one document has both rare terms, the rounds score few of the others."""
    docs = np.arange(5000, dtype="<i4")
    impacts = np.full(5000, 10, "<i4")
    impacts[2500] = 1000
    owner, ends = lexical.block_ends(impacts.astype(np.int64), np.array([0]), np.array([5000]), 64, 100)
    first = np.concatenate([[0], ends[:-1]])
    lists = {b"a": (docs, impacts, ends.astype("<i4"), np.maximum.reduceat(impacts, first))}
    assert (ends[np.searchsorted(ends, 2500, side="right")] - first[np.searchsorted(ends, 2500, side="right")]) == 1  # a block of its own
    assert list(lexical.search_shard(lists, np.arange(5000), {7: [b"a"]}, {b"a": 3}, 1)) == [(7, 2500, 3000)]


def test_search_awkward_rows(spark):
    odd = awkward(spark)
    items = [(1, "one TWO"), (2, "five words"), (3, "don't ŒUVRE")]
    got = [tuple(r) for r in lexical.rank(clashing(odd), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted(plain_search([(r.doc_id, r.text) for r in odd.collect()], items), key=repr)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.rank(empty(spark), asked).count() == 0
    assert lexical.rank(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- filter audit ---------------------------------------------------------------------------------------


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aA# \t\n é漢\U0001f600\x00\x1f\x85 Zz|")) | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8), st.integers(0, 3))
def test_measures_equal_plain_ones(texts, skip):
    array = pa.array(texts + ["tail word"])[min(skip, len(texts)) :]
    assert np.array(filter_audit.measure(array)).T.tolist() == [plain_measures(t) for t in array.to_pylist()]


def test_measures_of_long_words():
    texts = ["x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + "y", "abcdefgh abcdefghi abcdefgh", "", "q" * 1024 + " " + "q" * 1025, " "]
    assert np.array(filter_audit.measure(pa.array(texts))).T.tolist() == [plain_measures(t) for t in texts]


def test_colliding_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(shingles, "word_hashes", lambda data, starts, lengths: np.zeros(len(starts), np.uint64))
    texts = ["a b a c", "one one", "", "x y z"]
    assert np.array(filter_audit.measure(pa.array(texts))).T.tolist() == [plain_measures(t) for t in texts]


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    first: dict = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, part in docs:
        words, distinct, capitals, symbols, size = plain_measures(t or "")
        fails = {f for f, x in zip("ABCDE", (words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * size, symbols > 0, d is not None and d > first[t or ""]), strict=True) if x}
        rows.append((part or "", fails, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                failing = sum(f in r[1] for r in mine)
                out[part, "".join(order), i + 1] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = total[out[key][6]]
    return out


def test_audit_against_running_every_order(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in awkward(spark).collect()]
    docs += [(7, None, "de"), (5, "", "fr"), (14, "exactly five words right here", "de"), (13, "exactly five words right here", "fr"), (None, "exactly five words right here", "fr")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(1, 40)] + [(2, 1, 1), (None, 1, 1), (25, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(docs, labels)
    for given_docs in (frame, clashing(frame)):
        rows = filter_audit.audit(given_docs, marks).collect()
        got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
        assert len(rows) == len(got) == 600 * len({d[2] or "" for d in docs})
        assert got == want
    assert filter_audit.audit(empty(spark), marks).count() == 0
    assert filter_audit.audit(frame, marks.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_filter_audit"])
def test_queries_against_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    out = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(out.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in out.select(*columns).collect()) == sorted(want)
