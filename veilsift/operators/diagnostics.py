"""Counters at the boundaries that signals pass: after detection, after policy, after deduplication, shown.

Each boundary is an ``observe`` on the rows that pass it, so counting costs no job and no pass of its
own; batches and streams count alike. What has been counted is read back as rows of a table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BOUNDARIES = ("detection", "policy", "dedup", "shown")
#: The types that are counted one by one.
TYPES = ("pii", "confidential", "financial", "legal", "ip", "sensitive")
COUNTERS = "run string, boundary string, id string, n long"
#: Names of a boundary's metrics: rows in all, visible rows, and a kind that is none of the known ones.
TOTAL, VISIBLE, OTHER = "total", "visible", "other"


def metrics(kinds: Sequence[str], kind: Column, visible: Column | None = None) -> list[Column]:
    """Aggregates of one boundary: rows in all, of each kind, of others (nulls too), and visible ones."""
    known = F.coalesce(kind.isin(*kinds), F.lit(False))
    out = [F.count(F.lit(1)).alias(TOTAL), *[F.count_if(kind == k).alias(k) for k in kinds], F.count_if(~known).alias(OTHER)]
    return out if visible is None else [*out, F.count_if(visible).alias(VISIBLE)]


class Counters:
    """The counters of one run. ``watch`` each boundary, run one action over the last frame, then ask for ``table``."""

    def __init__(self, run: str, kinds: Sequence[str] = TYPES):
        self.run, self.kinds = run, tuple(kinds)
        self.seen: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, boundary: str, kind_col: str = "type", visible: Column | None = None) -> DataFrame:
        """``df`` as it is; rows that pass are counted by the values of ``kind_col``. For batches."""
        seen = Observation(f"{self.run}/{boundary}")
        self.seen.append((boundary, seen))
        return df.observe(seen, *metrics(self.kinds, F.col(kind_col), visible))

    def table(self, spark: SparkSession) -> DataFrame:
        """COUNTERS of the boundaries, zeros left out; waits for the action. A boundary that saw no row has its total alone."""
        rows = [r for boundary, seen in self.seen for r in counted(self.run, boundary, seen.get)]
        return spark.createDataFrame(rows, COUNTERS)


def counted(run: str, boundary: str, found: dict[str, int]) -> list[tuple[str, str, str, int]]:
    """Rows of COUNTERS from a boundary's metrics."""
    return [(run, boundary, k, int(n)) for k, n in found.items() if n or k == TOTAL]


def watch_stream(df: DataFrame, boundary: str, kind_col: str = "type", kinds: Sequence[str] = TYPES, visible: Column | None = None) -> DataFrame:
    """The same for streams: the counts of each batch come with the query's progress under the boundary's name."""
    return df.observe(boundary, *metrics(kinds, F.col(kind_col), visible))


def of_progress(progress: Iterable, boundaries: Sequence[str] = BOUNDARIES) -> list[tuple[str, str, str, int]]:
    """Rows of COUNTERS from a query's progress reports, a run for each batch."""
    return [r for p in progress for b in boundaries if b in p.observedMetrics for r in counted(f"{p.runId}/{p.batchId}", b, p.observedMetrics[b].asDict())]


def removed(counters: DataFrame) -> DataFrame:
    """How many rows of each run deduplication took: run, removed."""
    n = lambda b: F.sum(F.when((F.col("boundary") == b) & (F.col("id") == TOTAL), F.col("n")))
    return counters.groupBy("run").agg((n("policy") - n("dedup")).alias("removed"))
