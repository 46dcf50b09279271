"""The registered queries and the pipeline's stages on awkward, empty and small tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilsift.llm import exact, mixing, queries, shingles

from .fixtures import awkward, clashing, empty
from .test_near_dedup import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Awkward documents as tables; their labels are one of each kind, a repeated and a null one."""
    root = str(tmp_path_factory.mktemp("tables"))
    awkward(spark).coalesce(1).write.parquet(f"{root}/documents.parquet")
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 30)] + [(3, 0, 1), (None, 1, 0), (25, None, None)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("nothing"))
    empty(spark).coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op1_packing", "op12_lexical_search", "op13_filter_audit")])
def test_queries_give_a_row_for_every_document(spark, folder, name):
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert queries.QUERIES[name](spark, folder).count() == rows


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_of_an_empty_table(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_near_duplicates_query_against_all_pairs(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in queries.op3_minhash_dedup(spark, folder).where("doc_id is not null").collect()]
    assert sorted(got) == brute(rows, 85)


def test_exact_duplicates_query_against_its_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in queries.op7_exact_dedup(spark, folder).where("doc_id is not null").collect()]
    want = con.sql(f"SELECT doc_id, keep_id, group_size, text_sha256 FROM ({exact.EXACT_SQL}) WHERE doc_id IS NOT NULL").fetchall()
    assert sorted(got) == sorted(want)


def test_mixing_query_against_plain_raking(spark, sf_dir):
    """Cells from the query's rows, raked by proportions alone; draws by the documented hash."""
    rows = queries.op10_mixing(spark, sf_dir).collect()
    cells: dict = {}
    for r in rows:
        cells.setdefault((r.source, r.lang, r.topic), [0, r.probability])[0] += r.tokens
    keys, tokens = list(cells), np.array([c[0] for c in cells.values()], float)
    budget, w = 0.5 * tokens.sum(), tokens * 0.5
    goals = []
    for d in range(3):
        sums: dict = {}
        for k, v in zip(keys, tokens, strict=True):
            sums[k[d]] = sums.get(k[d], 0) + v
        whole = sum(v**0.7 for v in sums.values() if v)
        goals.append({k: budget * v**0.7 / whole if v else 0.0 for k, v in sums.items()})
    for _ in range(200):
        for d in range(3):
            now: dict = {}
            for k, v in zip(keys, w, strict=True):
                now[k[d]] = now.get(k[d], 0) + v
            w = np.array([v * goals[d][k[d]] / now[k[d]] if now[k[d]] else 0.0 for k, v in zip(keys, w, strict=True)])
        w = np.minimum(w, tokens)
    for k, v, t in zip(keys, w, tokens, strict=True):
        if t:
            assert abs(cells[k][1] - v / t) < 1e-3, k
    draws = {r.doc_id: r.u for r in spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long").select("doc_id", (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11).cast("double") * 2.0**-53).alias("u")).collect()}
    assert all(r.kept == (draws[r.doc_id] < r.probability) for r in rows)


def test_topics_part_texts_of_different_words(spark):
    """Texts of three disjoint vocabularies fall into three topics, each the nearest centre by plain cosine."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{t}{w}" for w in rng.integers(0, 40, 60)) for t in ("sea", "law", "gene") for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = mixing.fit_topics(docs, topics=3)
    topics = {r.doc_id: r["__topic"] for r in mixing.with_topic(docs, model).collect()}
    assert [len({topics[i] for i in range(k, k + 40)}) for k in (0, 40, 80)] == [1, 1, 1] and len(set(topics.values())) == 3
    for i, text in enumerate(texts):
        h = shingles.runs([text.encode()], mixing._LETTERS)[0]
        counts = np.bincount((h >> np.uint64(40)).astype(np.int64) % 1024, minlength=1024)
        x = np.log1p(counts) * model.weights
        assert topics[i] == int(np.argmax(model.centres @ x))


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_stand_awkward_and_empty_tables(spark, folder, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    for docs in (spark.read.parquet(f"{folder}/documents.parquet"), clashing(awkward(spark)), empty(spark)):
        out = run(spark, docs, folder)
        n = out.count()
        if stage == "packing":
            assert (n == 0) == (docs.count() == 0)
        else:
            assert out.columns == docs.columns and n <= docs.count()


def test_pipeline_of_an_empty_table(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_pipeline_of_awkward_rows(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
