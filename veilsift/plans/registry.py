"""All registered queries of the engine and their DuckDB SQL, from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archetype_queries, block_queries, card_queries, checksum_queries, class_queries, decision_queries, degraded_queries, fallback_queries, frame_queries, guard_queries, phone_queries, policy_queries, rule_queries, scan_queries, signal_queries, stream_queries, text_queries

MODULES = [decision_queries, checksum_queries, scan_queries, signal_queries, text_queries, class_queries, guard_queries, archetype_queries, degraded_queries, block_queries, rule_queries, fallback_queries, stream_queries, policy_queries, frame_queries, card_queries, phone_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
