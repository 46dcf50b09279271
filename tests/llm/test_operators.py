"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import array
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilsift.llm import common, exact, line_templates, merkle, mixing, packing, quality, token_files, toxicity, wordpiece

from .fixtures import SCHEMA, awkward, clashing, empty

TOKENIZER = common.default_tokenizer()


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    return lambda text: array.array("I", [*own.encode(text or "", add_special_tokens=False).ids, 2]).tobytes()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


# --- encoding, packing, token files ---------------------------------------------------------------------


def test_encoder_equals_the_library(reference_ids):
    own = common.Encoder(common.tokenizer_spec(TOKENIZER), room=50)
    assert own.known
    rng = random.Random(1)
    chars = [chr(c) for c in range(32, 0x250)] + list("\n\t\r '''sSmMdDlLrRveEtT!.,<|>") + ["İ", "ʼ", "́", "漢", "\U0001f600", "<|endoftext|>", "'s"]
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 30)))
        assert own.encode([text])[0] + array.array("I", [2]).tobytes() == reference_ids(text), text


def check_packing(rows, texts, reference_ids, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, text in texts.items():
        ids = reference_ids(text)
        parts = sorted(by_doc[d], key=lambda r: r.start)
        at = 0
        for r in parts:
            assert r.start == at and 0 < r.length <= capacity and r.doc_tokens == len(ids) // 4
            assert zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert at == len(ids) // 4
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sequences


def test_packing_is_exact_and_tight(spark, documents, reference_ids):
    rows = packing.pack_documents(documents, group_pieces=64).collect()
    sequences = check_packing(rows, {r.doc_id: r.text for r in documents.collect()}, reference_ids, 4096)
    filled = sum(r.length for r in rows)
    whole = packing.pack_documents(documents).collect()
    assert len({r.sequence_id for r in whole}) * 4096 < 1.03 * filled + 4096
    assert len(sequences) >= len({r.sequence_id for r in whole})


def test_packing_awkward_rows(spark, reference_ids):
    df = awkward(spark).where("doc_id is not null and doc_id <> 13")
    rows = packing.pack_documents(clashing(df), capacity=128, group_pieces=8).collect()
    check_packing(rows, {r.doc_id: r.text for r in df.collect()}, reference_ids, 128)
    assert packing.pack_documents(awkward(spark)).where("doc_id is null or doc_id = 13").count() == 4
    assert packing.pack_documents(empty(spark)).count() == 0


def test_first_fit_decreasing_equals_a_linear_scan():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        bins, offsets = packing.first_fit_decreasing(np.array(lengths), 100)
        room, want = [], [0] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((b for b, left in enumerate(room) if left >= lengths[i]), len(room))
            if b == len(room):
                room.append(100)
            room[b] -= lengths[i]
            want[i] = b
        assert bins.tolist() == want


def test_token_files_round_trip(spark, reference_ids, tmp_path):
    df = awkward(spark)
    manifest = token_files.write_token_files(clashing(df), f"file://{tmp_path}/t", TOKENIZER, frame_ids=500, shards=3)
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    at = 0
    for r, (_, text) in zip(rows, want, strict=True):
        ids = reference_ids(text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    some = spark.createDataFrame([(10,), (13,), (25,), (999,), (None,)], "doc_id long")
    got = sorted((r.doc_id, bytes(r.ids)) for r in token_files.read_documents(manifest, some).collect())
    assert got == sorted((d, reference_ids(t)) for d, t in want if d in (10, 13, 25))
    assert token_files.read_token_files(token_files.write_token_files(empty(spark), f"file://{tmp_path}/e", TOKENIZER)).count() == 0


def test_damaged_frames_are_noticed(tmp_path):
    import pyarrow as pa

    path = tmp_path / "x.tokz"
    with pa.OSFile(str(path), "wb") as sink:
        shard = token_files.ShardWriter(sink, frame_ids=4)
        for d in range(6):
            shard.add(d, array.array("I", range(d, d + 3)).tobytes())
        shard.close()
    reader = token_files.ShardReader(pa.OSFile(str(path)))
    assert [d for d, _ in reader.frames()] == list(range(6)) and len(reader.table) == 6
    data = bytearray(path.read_bytes())
    data[-9 - 12 * 6 + 8] ^= 1  # the first frame's checksum
    path.write_bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.ShardReader(pa.OSFile(str(path))).frame(0))
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()
    assert len(plain) == 6 * (4 + 16 + 12)


# --- exact duplicates -----------------------------------------------------------------------------------


def test_exact_duplicates_against_grouping(spark):
    df = awkward(spark)
    rows = exact.exact_duplicates(clashing(df), bucket_bytes=4000, max_depth=6).collect()
    groups = {}
    plain = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for r in df.collect():
        groups.setdefault(plain(r.text), []).append(r.doc_id)
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    order = lambda x: (x[0] is None, x[0] or 0, x[4])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows], key=order) == sorted(want, key=order)
    assert exact.exact_duplicates(empty(spark)).count() == 0
    assert exact.exact_dedup(df).columns == df.columns


def test_a_hot_group_is_looked_up_by_broadcast(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", "en", "s", 0) for i in range(600)]
    out = exact.exact_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.where("keep_id = 1").count() == 400 and out.where("kept").count() == 201


def test_a_repeated_id_keeps_its_own_text_only(spark):
    rows = [(1, "a x", "en", "s", 0), (2, "b x", "en", "s", 0), (2, "a  x", "en", "s", 0), (2, "b x", "en", "t", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("__kept_id", F.lit(7))
    assert sorted((r.doc_id, r.text) for r in exact.exact_dedup(docs).collect()) == [(1, "a x"), (2, "b x"), (2, "b x")]


def test_colliding_hashes_are_chained(spark):
    """Few hash bits force collisions: groups stay those of the texts, chains tell texts of one hash apart."""
    rng = random.Random(21)
    texts = [f"text {rng.randint(0, 60)} {'x' * rng.randint(0, 3)}" for _ in range(500)] + ["hot text"] * 400
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    plain = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact.exact_duplicates(docs).collect()}
    out = exact.exact_duplicates(docs, bucket_bytes=900, max_depth=5, hash_bits=5).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in out} == plain
    for d, t in enumerate(texts):
        assert plain[d][:2] == (texts.index(t), texts.count(t))
    assert max(r.chain for r in out) > 1 and len({r.bucket for r in out}) > 4
    places = {(r.bucket, r.chain, r.text_sha256) for r in out}
    assert len({p[2] for p in places}) == len(places)


def test_directory_points_every_slot_at_one_bucket():
    depth, pointed = exact.pointers([(0, 2, 1), (4, 3, 1), (6, 3, 1), (8, 1, 1)], 4)
    assert depth == 3 and pointed == [0, 0, 1, 2, 3, 3, 3, 3]
    assert exact.pointers([], 4) == (0, [0])


def test_directory_splits_overfull_buckets(spark):
    counts = spark.createDataFrame([(s, 10) for s in range(16)] + [], "slot int, n long")
    got = exact.directory(counts, 25, 4)
    assert all(n <= 25 for _, _, n in got) and sum(n for *_, n in got) == 160
    hot = exact.directory(spark.createDataFrame([(5, 100)], "slot int, n long"), 10, 4)
    assert (5, 4, 100) in hot


# --- fingerprints ---------------------------------------------------------------------------------------


def test_fingerprints_follow_the_contract(spark, documents):
    texts = sorted((r.doc_id, r.text or "") for r in documents.collect())
    got = {r.doc_id: r for r in merkle.fingerprints(documents, bins=5).collect()}
    assert len(got) == len(texts)
    for i, (d, text) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (merkle.fingerprint(text), merkle.fingerprint(edited))
        assert (r.near_next == 1) == (text == following) and 0 <= r.near_edited <= 1
    long = [got[d] for d, t in texts if len(t) > 400]
    assert np.mean([r.near_edited for r in long]) > 0.6 > 0.2 > np.mean([r.near_next for r in long if r.near_next < 1])


def test_fingerprints_of_awkward_rows(spark):
    out = merkle.fingerprints(clashing(awkward(spark)), bins=4)
    assert out.count() == awkward(spark).count()
    assert merkle.fingerprints(empty(spark)).count() == 0
    one = merkle.fingerprints(awkward(spark).where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_edits_are_located():
    old = "Alpha beta gamma delta.\nSecond paragraph stays here.\n\nNew section with words in it.\nLast line of all."
    new = old.replace("words in it", "terms in it")
    spans = merkle.edits(old, new)
    assert spans and all("words" in old[a:b] if side == "removed" else "terms" in new[a:b] for side, a, b in spans)
    assert merkle.edits(old, old) == [] and merkle.Tree("a b").root != merkle.Tree("a  b").root


def test_fingerprints_tell_which_branches_differ():
    """Against the paragraphs themselves: every changed, added or moved-in paragraph and no other."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    prose = lambda: " ".join(word() for _ in range(rng.randint(1, 30)))
    for _ in range(20):
        old = [[prose() for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        new = [list(ps) for ps in old]
        for _ in range(rng.randint(0, 3)):
            ps = rng.choice(new)
            ps[rng.randrange(len(ps))] = prose()
        if rng.random() < 0.5:
            new.insert(rng.randint(0, len(new)), [prose()])
        a, b = ("\n\n".join("\n".join(ps) for ps in t) for t in (old, new))
        every = [{p for ps in t for p in ps} for t in (old, new)]
        want = [(side, i, j) for side, own, other in (("a", old, every[1]), ("b", new, every[0])) for i, ps in enumerate(own) for j, p in enumerate(ps) if p not in other]
        assert merkle.differing(merkle.fingerprint(a), merkle.fingerprint(b)) == want
    assert merkle.differing(merkle.fingerprint(""), merkle.fingerprint("x")) == [("a", 0, 0), ("b", 0, 0)]


def test_long_texts_share_sampled_leaves():
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(30_000)]
    a, b = " ".join(words), " ".join(words[:15_000])
    assert len(merkle.fingerprint(a)) < 60 + 10 * merkle.LEAVES
    assert abs(merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) - 0.5) < 0.12


def test_repeated_lines_keep_their_leaves(spark):
    line = "2024-01-01 host app[12]: request served in 17 ms\n"
    assert merkle.fingerprint(line * 2000).split(".")[1] == "0" and merkle.fingerprint(line * 2000).split(".")[3]
    near = merkle.likeness(merkle.fingerprint(line * 2000), merkle.fingerprint(line * 1500))
    assert abs(near - 0.75) < 0.01
    rng = random.Random(6)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20_000))
    texts = [line * 2000, "an unrelated text of a few words only", long, long[: len(long) // 3]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    for r in merkle.fingerprints(spark.createDataFrame(rows, SCHEMA), bins=2).collect():
        text, following = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        q = len(text) // 4
        for other, got in ((text[: len(text) - q] + following[:q], r.near_edited), (following, r.near_next)):
            a, b = (merkle.Counter(merkle.Tree(t).leaves()) for t in (text, other))
            assert got == (a & b).total() / max(a.total(), b.total())


# --- line dedup -----------------------------------------------------------------------------------------


def test_recurring_lines_go_from_all_but_the_first(spark):
    notice = "This notice number 17 recurs in many documents of the table"
    long = " ".join(f"word{i}" if i % 7 else f"word{i}." for i in range(90))
    rows = [(i, f"Own line of document number {'abc'[i % 3] * (i + 1)} alone\n{notice.replace('17', str(i))}\nshort one\n{long}", "en", "s", 0) for i in range(1, 8)]
    rows.append((20, long, "en", "s", 0))
    out = {r.doc_id: r for r in line_templates.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1].text == rows[0][1] and out[1]["__dropped"] == 0
    for i in range(2, 8):
        assert notice.split(" number")[0] not in out[i].text and "short one" in out[i].text and "Own line" in out[i].text
        assert "word80" not in out[i].text
    kept = {r.doc_id for r in line_templates.without_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(range(1, 8)) or kept == {*range(1, 8), 20}
    none = line_templates.dedup_lines(spark.createDataFrame(rows, SCHEMA), keep_first=False).collect()
    assert all("This notice" not in r.text for r in none)


def test_one_quarter_of_a_line_may_vary(spark):
    words = [f"token{chr(97 + i)}" for i in range(24)]
    rows = [(i, " ".join([*words[:20], *(f"{c}{'x' * i}" for c in "pqrs")]), "en", "s", 0) for i in range(1, 5)]
    rows.append((9, " ".join(reversed(words)), "en", "s", 0))
    out = {r.doc_id: r["__dropped"] for r in line_templates.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: 0, 2: 1, 3: 1, 4: 1, 9: 0}


def test_short_sentences_of_a_spliced_passage_go_too(spark):
    passage = "the harbour was quiet that morning. The boats had left before the sun came up. Nobody spoke. They had taken all of the nets with them. It was cold. Gulls walked over the empty planks of the pier. Then"
    rows = [(i, f"{own} {passage} {' '.join(own.split()[::-1])} once more", "en", "s", 0) for i, own in enumerate(["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black"], 1)]
    rows.append((9, " ".join(f"other{i}" for i in range(50)) + " end here. Nobody spoke. Another sentence follows in this place.", "en", "s", 0))
    out = {r.doc_id: r.text for r in line_templates.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1] == rows[0][1] and out[9] == rows[3][1]
    for d in (2, 3):
        assert "Nobody spoke" not in out[d] and "It was cold" not in out[d] and "boats" not in out[d]


def test_a_field_of_a_line_of_twelve_words_may_vary(spark):
    rows = [(i, f"The thread was moved to the archive by moderator {name} of the forum", "en", "s", 0) for i, name in enumerate(["Alice", "Bob", "Carol"], 1)]
    out = {r.doc_id: r["__dropped"] for r in line_templates.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: 0, 2: 1, 3: 1}


def test_line_dedup_against_brute_force(spark, documents):
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    seen = {}
    for d, t in texts.items():
        units = line_templates.Units([t])
        for u, s in zip(*units.templates(), strict=True):
            seen.setdefault(int(s), []).append((d, int(units.number[u])))
    drops = {}
    for hits in seen.values():
        ids = {d for d, _ in hits}
        if len(ids) > 1:
            for d, u in hits:
                if d != min(ids):
                    drops.setdefault(d, set()).add(u)
    got = {r.doc_id: r for r in line_templates.dedup_lines(documents).collect()}
    for d, t in texts.items():
        want = line_templates.without(t, drops[d]).decode() if d in drops else t.decode()
        assert got[d].text == want and got[d]["__dropped"] == len(drops.get(d, ()))


def test_line_dedup_awkward_rows(spark):
    df = awkward(spark)
    out = line_templates.dedup_lines(clashing(df))
    assert out.count() == df.count() and out.where("doc_id = 2").first()["text"] == ""
    assert out.where("doc_id is null and text is null").count() == 1
    assert line_templates.dedup_lines(empty(spark)).count() == 0
    assert line_templates.without_recurring_lines(df).columns == df.columns


# --- word-piece counts ----------------------------------------------------------------------------------


def test_automaton_counts_like_greedy_match():
    rng = random.Random(7)
    for _ in range(60):
        starts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        continues = starts if rng.random() < 0.4 else {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        own = wordpiece.Automaton(starts, continues)
        for _ in range(40):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
            assert own.count(word) == wordpiece.greedy_count(word, starts, continues), (word, starts, continues)


def test_token_counts_of_documents(spark, documents):
    starts, continues = wordpiece.vocabulary(common.tokenizer_spec(TOKENIZER))
    own = wordpiece.Automaton(starts, continues)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in wordpiece.token_counts(documents).collect():
        words = wordpiece._UNITS.findall(texts[r.doc_id].lower())
        assert r.n_words == len(words)
        if r.doc_id % 10 == 0:
            assert r.n_tokens == sum(wordpiece.greedy_count(w + "\n", starts, continues) for w in words) == sum(own.count(w + "\n") for w in words)
    out = {r.doc_id: r for r in wordpiece.token_counts(clashing(awkward(spark).where("doc_id < 13"))).collect()}
    assert out[5].n_tokens == out[6].n_tokens == 0 and out[8].n_words == 2
    assert wordpiece.token_counts(empty(spark)).count() == 0


# --- models ---------------------------------------------------------------------------------------------


def test_quality_tells_junk_from_prose(spark, documents, labels):
    out = quality.resample(documents, labels).join(labels, "doc_id").select("quality", "__kept").collect()
    good, bad = [r["__kept"] for r in out if r.quality == 1], [r["__kept"] for r in out if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    assert quality.filter_quality(documents, labels).columns == documents.columns


def test_gumbel_top_k_against_sorting(spark, documents, labels):
    rows = quality.resample(documents, labels, keep=0.4, temperature=5.0).select("__gumbel_key", "__kept").collect()
    k = round(0.4 * len(rows))
    least = sorted((r["__gumbel_key"] for r in rows), reverse=True)[k - 1]
    assert all(r["__kept"] == (r["__gumbel_key"] >= least) for r in rows)


def plain_ngrams(text, buckets):
    """Buckets of a text's n-grams, token by token."""
    from veilsift.llm import shingles

    found = list(re.finditer(r"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d ]+", text.encode().decode("latin-1")))
    tokens = [m.group().encode("latin-1") for m in found]
    mix = lambda x: int(shingles.mix(np.array([x % 2**64], np.uint64))[0])
    hashes = [int(shingles.runs([t], quality._CLASS)[0][0]) for t in tokens]
    forms = []
    for i, (t, h) in enumerate(zip(tokens, hashes, strict=True)):
        word = re.match(rb"[0-9A-Za-z\x80-\xff]", t) is not None
        capitals = sum(65 <= c <= 90 for c in t)
        caps = 3 if len(t) == 1 else 0 if not capitals else 2 if capitals == len(t) else 1
        form = h if not word else (4 + caps) * 64 + min(len(t), 15) * 2 + (h in hashes[max(0, i - 2) : i])
        forms.append(mix(form + 77))
    pairs = [mix(a * 3 + b) for a, b in zip(forms, forms[1:], strict=False)]
    return [(x >> 40) % buckets for x in hashes + pairs]


def test_importance_weights_and_keys_against_a_plain_model(spark, documents, labels):
    """Counts, log weights, Gumbel noise and the default k of the query's own options, without the operator's arrays."""
    import math

    from veilsift.llm import queries

    out = {r.doc_id: r for r in queries.op2_quality_classifier(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    grams = {d: plain_ngrams(t, 65_536) for d, t in texts.items()}
    raw, target = np.zeros(65_536), np.zeros(65_536)
    for d, g in grams.items():
        for spot in g:
            raw[spot] += 1
            target[spot] += known.get(d) == 1
    ratio = [math.log((a + 1) / (target.sum() + 65_536)) - math.log((b + 1) / (raw.sum() + 65_536)) for a, b in zip(target, raw, strict=True)]
    noise = {r.doc_id: r.g for r in documents.select("doc_id", quality.gumbel("doc_id", 11).alias("g")).collect()}
    for d, g in grams.items():
        w = sum(ratio[spot] for spot in g)
        assert abs(out[d].log_weight - w) < 1e-6 * max(1, abs(w)) and abs(out[d].gumbel_key - w - noise[d]) < 1e-6 * max(1, abs(w))
    # each row counts with the share of good labels in its stratum; with fewer than 1000 labelled rows a stratum is one row
    weights = sorted((out[d].log_weight, y) for d, y in known.items() if d in out)
    nearest = lambda w: [y for v, y in weights if v == min((v for v, _ in weights), key=lambda v: (abs(v - w), -v))]
    k = round(sum(np.mean(nearest(r.log_weight)) for r in out.values()))
    assert sum(r.kept for r in out.values()) == k
    kept = sorted((r.gumbel_key for r in out.values()), reverse=True)[k - 1]
    assert all(r.kept == (r.gumbel_key >= kept) for r in out.values())


def test_gumbel_noise_samples_in_proportion_to_weights(spark):
    """The first place of top-k over many seeds follows the weights."""
    weights = {1: 1.0, 2: 2.0, 3: 5.0}
    df = spark.createDataFrame([(d,) for d in weights], "doc_id long")
    many = df.select("doc_id", *[quality.gumbel("doc_id", seed).alias(f"g{seed}") for seed in range(400)]).collect()
    first = [max(weights, key=lambda d: np.log(weights[d]) + {r.doc_id: r[f"g{seed}"] for r in many}[d]) for seed in range(400)]
    for d, w in weights.items():
        assert abs(first.count(d) / 400 - w / 8) < 0.08


def test_nth_smallest_is_exact(spark):
    rng = random.Random(9)
    values = [rng.choice([0.0, 1e-9, 5.5, rng.gauss(0, 1), rng.gauss(0, 1e6)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for n in (1, 2, 250, 499, 500):
        assert common.nth_smallest(df, "x", n, bins=7) == sorted(values)[n - 1]
    assert common.nth_smallest(df, "x", 501) is None


def test_quality_awkward_rows(spark, labels):
    df = awkward(spark)
    for known in (labels, labels.limit(0)):
        out = quality.resample(clashing(df), known)
        assert out.count() == df.count()
    assert quality.resample(empty(spark), labels).count() == 0


def test_block_max_index_is_exact():
    rng = random.Random(11)
    make = lambda: toxicity.unit({rng.randint(0, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 8))}, np.linspace(1, 5, 41))
    vectors = [make() for _ in range(300)]
    index = toxicity.BlockMaxIndex(vectors, 41)
    for _ in range(100):
        query = make()
        got, want = index.top(query, 15), toxicity.brute_force_top(vectors, query, 15)
        assert np.allclose([s for s, _ in got], [s for s, _ in want])


def test_toxicity_on_held_out_rows(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.toxicity(docs, known).join(known, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    tops = [r.score for r in rows if r.toxic]
    assert right > 0.93 and np.mean(tops) > 3 * np.mean([r.score for r in rows if not r.toxic])
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def test_toxicity_awkward_rows(spark, labels):
    df = awkward(spark)
    assert toxicity.toxicity(clashing(df), labels).count() == df.count()
    assert toxicity.toxicity(df, labels.limit(0)).count() == df.count()
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_raking_meets_targets():
    rng = np.random.default_rng(13)
    keys = [(s, la, t) for s in "abc" for la in "xy" for t in range(3)]
    tokens = rng.integers(1000, 5000, len(keys)).astype(float)
    targets = [{"a": 0.4, "b": 0.3, "c": 0.3}, {"x": 0.55, "y": 0.45}, {0: 0.3, 1: 0.4, 2: 0.3}]
    w, error = mixing.rake(keys, tokens, targets, 0.4 * tokens.sum())
    assert error < 1e-5 and (w <= tokens + 1e-9).all()
    for d, target in enumerate(targets):
        for v, share in target.items():
            assert abs(sum(x for x, k in zip(w, keys, strict=True) if k[d] == v) / w.sum() - share) < 1e-4
    w, error = mixing.rake([("a", "x", 0)], np.array([10.0]), [{"a": 0.5, "b": 0.5}, {"x": 1.0}, {0: 1.0}], 5.0)
    assert error > 0.1


def test_mixing_meets_its_expectations(spark, documents):
    rows = mixing.mix(documents, share=0.5).collect()
    cells = {}
    for r in rows:
        cells.setdefault((r.source, r.lang, r["__topic"]), set()).add(round(r["__probability"], 9))
    assert all(len(p) == 1 for p in cells.values())
    total = sum(r["__tokens"] for r in rows)
    assert abs(sum(r["__tokens"] * r["__probability"] for r in rows) / total - 0.5) < 0.02
    kept = sum(r["__tokens"] for r in rows if r["__kept"])
    assert 0.3 < kept / total < 0.7
    words = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in rows}
    assert all(words[r.doc_id] == r["__tokens"] for r in rows)


def test_mixing_awkward_rows(spark):
    df = awkward(spark)
    assert mixing.mix(clashing(df)).count() == df.count()
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed(df, share=1.0, power=1.0).count() == df.count()


def test_topic_weights_and_centres_cover_all_rows(spark):
    rng = random.Random(4)
    themes = [[f"{t}{i}" for i in range(30)] for t in ("sea", "law", "gene")]
    rows = [(i, " ".join(rng.choices(themes[i % 3], k=40)), "en", "s", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    few, every = (mixing.fit_topics(docs, topics=3, seeds=n) for n in (6, 120))
    texts = [t.encode() for _, t, *_ in rows]
    counts = mixing.TopicModel.features(texts, 1024)
    assert np.allclose(few.weights, np.log(121 / ((counts > 0).sum(axis=0) + 1)), atol=1e-5) and np.array_equal(few.weights, every.weights)
    near = few.assign(texts)
    x = few.directions(counts)
    for t in range(3):
        total = x[near == t].sum(axis=0)
        assert not (near == t).any() or np.allclose(few.centres[t], total / np.linalg.norm(total), atol=1e-4)


def test_targets_out_of_reach_are_reported(spark):
    rng = random.Random(8)
    sizes = {"hot": 60, "mid": 25, "small": 5}  # small is below half the mean
    rows = [(i, " ".join(rng.choices("abcdefgh", k=50)), "en", s, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    with pytest.warns(UserWarning, match="source 'small': 250 of"):
        out = mixing.mix(spark.createDataFrame(rows, SCHEMA), share=0.8, topics=1)
    goal = mixing.tempered({s: 50.0 * n for s, n in sizes.items()}, 0.7)["small"]
    first = out.where("source = 'small'").first()
    assert first["__probability"] == 1 and first["__error"] >= goal - 250 / (0.8 * 4500) - 1e-9 > 0.01


# --- pipeline -------------------------------------------------------------------------------------------


def test_pipeline_stages_chain(spark, sf_dir, reference_ids):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, sf_dir), "test")
        assert out.columns == docs.columns and out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, reference_ids, 4096)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(whole.select("doc_id", "start", "length").collect()) == sorted((r.doc_id, r.start, r.length) for r in rows)
    assert whole.select(F.countDistinct("doc_id")).first()[0] == sizes[-1]
