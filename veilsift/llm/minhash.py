"""Near-duplicate documents by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, shingles

#: Sketch coordinates, in 16 bits each when sketches are compared.
COORDINATES = 252
#: A link's chance to share no band is below this.
MISS = 1e-5
#: Documents of one bucket that are compared with each other in one piece of work.
TILE = 512


def band_rows(threshold: float, t: int = COORDINATES, miss: float = MISS) -> int:
    """The most rows a band can have while a pair at the threshold misses all bands with chance ``miss`` at most."""
    fit = [r for r in range(1, t) if (1 - threshold**r) ** (t // r) <= miss]
    return max(fit, default=1)


def least_agreement(threshold: float, t: int = COORDINATES) -> int:
    """Coordinates on which a pair at the threshold agrees but for a chance of about one in a million."""
    return max(0, math.floor(t * threshold - 5 * math.sqrt(t * threshold * (1 - threshold))))


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def describe(docs: DataFrame, threshold: float, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set digest, band keys and 16-bit sketch of each document, in one narrow pass."""
    rows = band_rows(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, texts = batch.column(0), _bytes(batch.column(1))
            for at, to in shingles.blocks(texts):
                sets = shingles.shingle_sets(texts[at:to], size)
                sketch = shingles.sketches(sets, COORDINATES)
                keys = shingles.band_keys(sketch, rows).view(np.int64)
                lo, hi = shingles.set_digest(sets)
                low16 = shingles.mix(sketch).astype("<u2")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(at, to - at),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "lo": pa.array(lo), "hi": pa.array(hi),
                    "bands": pa.array(list(keys), pa.list_(pa.int64())),
                    "sketch": pa.array([r.tobytes() for r in low16], pa.binary()),
                })

    plain = docs.select(F.col(id_col).cast("long"), common.text_or_empty(text_col))
    return plain.mapInArrow(run, "doc_id long, n_shingles long, lo long, hi long, bands array<long>, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int = 5) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Pairs are laid out by a; a task reads a's text and then its partners one after another, holding
    one set and one batch. An a with many partners is split into several runs, each with a's text.
    """
    run_rows = 256
    runs = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / run_rows).cast("int").alias("runs"))
    runs = runs.where("runs > 1")
    many = pairs.join(runs, "a", "left").select("a", "b", F.coalesce("runs", F.lit(1)).alias("runs"))
    members = many.select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), F.lit(1).alias("turn"), F.col("b").alias("doc_id"))
    heads = members.select("a", "run").distinct().select("a", "run", F.lit(0).alias("turn"), F.col("a").alias("doc_id"))
    wanted = members.unionByName(heads)
    laid = texts.join(wanted.hint("shuffle_hash"), "doc_id").select("a", "run", "turn", "doc_id", "text")
    laid = laid.repartition(common.partitions(pairs.sparkSession), "a", "run").sortWithinPartitions("a", "run", "turn")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in common.slices(batches):
            a, turn, b = (batch.column(i).to_pylist() for i in (0, 2, 3))
            text = _bytes(batch.column(4))
            left, right = [], []
            for at, to in shingles.blocks(text):
                for i, s in enumerate(shingles.shingle_sets(text[at:to], size), at):
                    if turn[i] == 0:
                        # a repeated doc_id: its later sets come as further heads and count as one set of texts
                        head, own = (a[i], [*own, s]) if head == a[i] and turn_was == 0 else (a[i], [s])
                    elif head == a[i]:
                        for h in own:
                            both = shingles.overlap(h, s)
                            if both and 100 * both >= percent * (len(h) + len(s) - both):
                                left.append(a[i])
                                right.append(b[i])
                                break
                    turn_was = turn[i]
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return laid.mapInArrow(check, "a long, b long")


def _sum(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def open_groups(placed: DataFrame) -> DataFrame:
    """Groups within which pairs of different components are still to be compared: kind, key, node, comp, n.

    ``placed`` has key, node, n, comp for every member of a bucket. Buckets of one component are done,
    buckets with the same nodes are one. Where buckets overlap much (a large group of near copies
    shares most of its bands), the union of connected buckets is fewer rows and pairs than the buckets
    one by one; then it is one group, else each bucket is.
    """
    held = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"), F.min("node").alias("head"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"))
    unsettled = common.stored(held.where("x <> y").groupBy("size", "sum", "xor").agg(F.min("key").alias("key"), F.first("head").alias("head")).select("key", "head", "size"), "open-keys")
    rows = common.stored(graph.look_up(placed, unsettled, ["key"], "size", _sum(unsettled, "size")), "unsettled")
    clusters = common.stored(graph.components(rows.select("head", "node"), "head", "node"), "clusters")
    rows = rows.join(clusters.withColumnRenamed("label", "cluster"), "node")
    sizes = rows.groupBy("cluster", "node").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    sizes = common.stored(sizes.groupBy("cluster").agg(F.sum("size").alias("apart"), F.count(F.lit(1)).alias("nodes"), F.sum("rows").alias("rows")), "cluster-sizes")
    rows = graph.look_up(rows.drop("size"), sizes, ["cluster"], "rows", _sum(sizes, "rows"))
    union = F.col("nodes") * F.col("nodes") <= F.col("apart")
    return rows.select(union.alias("kind"), F.when(union, F.col("cluster")).otherwise(F.col("key")).alias("key"), "node", "comp", "n").distinct()


def open_links(groups: DataFrame, sketches: DataFrame, texts: DataFrame, agree: int, percent: int, size: int = 5) -> DataFrame:
    """Links (a, b) between nodes of one group that lie in different components, enough to join all that are linked.

    The nodes outside a group's largest component are its minors; every open pair has one. Minors and
    all nodes are cut into tiles of about TILE documents, and each pair of tiles is one run of rows that
    a task reads in order, so no group is ever held whole and a group with few minors moves each node
    once. Pairs whose sketches agree on ``agree`` coordinates are verified on full texts there and then,
    unless links found before have joined their components: a run gives fewer links than it has rows,
    however many pairs it compares.
    """
    parts = groups.groupBy("kind", "key", "comp").agg(F.count(F.lit(1)).alias("c"))
    facts = parts.groupBy("kind", "key").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("major"), F.max("c").alias("most"), F.sum("c").alias("all"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    facts = common.stored(facts.select("kind", "key", "major", "all", tiles(F.col("all") - F.col("most")).alias("minors"), tiles(F.col("all")).alias("alls")), "groups")
    rows = graph.look_up(groups, facts, ["kind", "key"], "all", _sum(facts, "all"))
    spread = lambda name: F.pmod(F.xxhash64("node", "key"), F.col(name)).cast("int")
    counted = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = rows.where(F.col("comp") != F.col("major")).select("kind", "key", spread("minors").alias("i"), counted("alls").alias("j"), F.lit(0).alias("side"), "node", "comp", "n")
    right = rows.select("kind", "key", counted("minors").alias("i"), spread("alls").alias("j"), F.lit(1).alias("side"), "node", "comp", "n")
    docs = sketches.join(texts, sketches["node"] == texts["doc_id"]).drop("doc_id")
    laid = docs.join(left.unionByName(right).hint("shuffle_hash"), "node").select("kind", "key", "i", "j", "side", "node", "comp", "n", "sketch", "text")
    laid = laid.repartition(common.partitions(groups.sparkSession), "kind", "key", "i", "j").sortWithinPartitions("kind", "key", "i", "j", "side")

    def compare(sides: tuple[list, list], out: tuple[list, list]) -> None:
        if not sides[0] or not sides[1]:
            return
        (node, comp, n), (onode, ocomp, on) = ([np.array([d[k] for d in side], np.int64) for k in range(3)] for side in sides)
        table = np.frombuffer(b"".join(d[3] for d in sides[1]), "<u2").reshape(len(onode), -1)
        sets: dict[tuple[int, int], np.ndarray] = {}

        def full(side: int, k: int) -> np.ndarray:
            if (side, k) not in sets:
                sets[side, k] = shingles.shingle_sets([sides[side][k][4]], size)[0]
            return sets[side, k]

        for k in range(len(node)):
            spots = np.flatnonzero((ocomp != comp[k]) & (100 * np.minimum(on, n[k]) >= percent * np.maximum(on, n[k])))
            if not len(spots):
                continue
            alike = (table[spots] == np.frombuffer(sides[0][k][3], "<u2")).sum(axis=1)
            for m in spots[alike >= agree][np.argsort(-alike[alike >= agree], kind="stable")].tolist():
                if ocomp[m] == comp[k]:
                    continue
                x, y = full(0, k), full(1, m)
                both = shingles.overlap(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out[0].append(int(node[k]))
                    out[1].append(int(onode[m]))
                    was, now = ocomp[m], comp[k]
                    comp[comp == was] = now
                    ocomp[ocomp == was] = now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: tuple[list, list] = ([], [])
                plain = [*(c.to_pylist() for c in batch.columns[:-1]), _bytes(batch.column(9))]
                for kind, key, i, j, side, *doc in zip(*plain, strict=True):
                    if (kind, key, i, j) != now:
                        compare(sides, out)
                        now, sides = (kind, key, i, j), ([], [])
                    sides[side].append(doc)
                if out[0]:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})
        out = ([], [])
        compare(sides, out)
        yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return laid.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their full sets of word
    shingles; a component's id is its smallest doc_id and that document is kept. Texts without words
    (null ones too) are linked with nothing. A null doc_id is linked with nothing, has a null
    component and is kept. Rows that share a doc_id are one node with the links of all of them. An
    empty table gives no rows; other columns are ignored.

    1. One pass describes each document; equal sets become one node (the smallest doc_id).
    2. Nodes that share a band form a bucket. The node with most company over all its bands leads
       each of its buckets; every member is verified against its leader on full texts: a number of
       pairs linear in the rows, however large a group of copies is.
    3. Components of the links. Buckets that still hold several components are compared in tiles;
       pairs whose sketches agree enough are verified on full texts unless they are in one
       component by then, and components are taken again. Texts travel with the tiles, once for each
       512 nodes of a group: fetching them by pair would move one for every pair of like sketches.

    Every lookup by band key, group or node goes through ``graph.look_up``, so a key that holds a
    third of all rows keeps its rows where they are.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    every = common.stored(describe(docs, threshold, size, id_col, text_col), "sketches")
    filled = every.where("n_shingles > 0 and doc_id is not null")
    classes = common.stored(filled.groupBy("lo", "hi").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n")), "classes")
    nodes = filled.join(classes.select("node", "lo", "hi"), [filled["doc_id"] == classes["node"], filled["lo"] == classes["lo"], filled["hi"] == classes["hi"]], "left_semi")
    nodes = nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "sketch").dropDuplicates(["node", "bands"])

    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = common.stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key-sizes")
    held = _sum(sizes, "size")
    shared = common.stored(graph.look_up(banded, sizes, ["key"], "size", held), "buckets")

    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = shared.join(company, "node")
    leaders = ranked.groupBy("key").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("a"), F.max_by("n", F.struct("company", -F.col("node"))).alias("an"), F.count(F.lit(1)).alias("members"))
    leaders = common.stored(leaders, "leaders")
    fits = 100 * F.least("n", "an") >= percent * F.greatest("n", "an")
    stars = graph.look_up(shared, leaders, ["key"], "members", held).where(F.col("node") != F.col("a")).where(fits).select("a", F.col("node").alias("b")).distinct()
    stars = common.stored(stars, "stars")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    links = common.stored(verified(stars, texts, percent, size), "links")

    labels = common.stored(graph.components(links), "labels")
    placed = shared.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("comp"))
    rest = common.stored(open_groups(placed), "open-groups")
    if not rest.isEmpty():
        more = common.stored(open_links(rest, nodes.select("node", "sketch"), texts, least_agreement(threshold), percent, size), "open-links")
        labels = common.stored(graph.components(links.unionByName(more)), "labels")

    named = classes.join(labels, "node", "left").select("lo", "hi", "rows", F.coalesce("label", "node").alias("component_id"))
    found = graph.look_up(filled.select("doc_id", "n_shingles", "lo", "hi"), named, ["lo", "hi"], "rows", _sum(classes, "rows")).select("doc_id", "n_shingles", "component_id")
    alone = every.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Null and blank texts, null and repeated ids and missing rows are as in ``near_duplicates``: texts
    without words and rows with a null doc_id stay, rows that share a kept doc_id all stay.
    """
    gone = near_duplicates(docs, percent, size, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone_id"], "left_anti")
