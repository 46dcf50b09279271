"""What readers are told over made decisions, and files shown together, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as bl
from ..operators import severity as sev
from ..sources import tables
from .scan_queries import _list, _quoted

Query = Callable[[SparkSession, str], DataFrame]

SHOWN = [*bl.FRAMES, "FRAME_UNKNOWN"]
REASONS = ["PDF_EXTRACTION_FAILED", "FRAMES_DEFAULT_APPLIED", "SIGNAL_BASED", "OTHER", "PDF_ENCRYPTED_PASSWORD_REQUIRED", "SIGNAL_BASED", "SIGNAL_BASED"]
TITLES = ["API key", "", "Social Security number"]
ESCALATIONS = ["none", "inline", "none", "modal", "none", "none", "inline"]


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def quality_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    events = tables.spread(tables.table(spark, sf_dir, "events").select("event_id", "user_id"))
    frame, title = F.when(e % 23 != 0, _pick(SHOWN, e % len(SHOWN))), F.when(e % 4 != 0, _pick(TITLES, e % len(TITLES)))
    confidence = bl.display_confidence(frame, _pick(sev.LEVELS, u % 5), e % 2, F.array(_pick(REASONS, u % len(REASONS))), F.when(e % 3 == 0, u % 11 == 0))
    nothing = F.lit(None).cast("string")
    made = events.select("event_id", frame.alias("frame"), title.alias("title"), confidence.alias("confidence"))
    return made.withColumn("b", bl.quality_blocks(F.col("frame"), F.col("confidence"), F.col("title"), nothing, nothing)).select("event_id", "confidence", "b.*")


def batch_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    lines = tables.table(spark, sf_dir, "lineitem")
    seen = F.when(k % 6 != 0, F.when((k + line) % 17 == 0, "interrupt").otherwise("notice"))
    made = lines.select(
        F.col("l_orderkey").alias("batch"), _pick(["none", "low", "none", "low", "none", "medium", "none"], (k + line) % 7).alias("severity"), _pick(ESCALATIONS, (k * 3 + line) % 7).alias("escalation"), seen.alias("visibility"),
        F.when(k % 5 == 0, line % 2).otherwise(0).alias("signal_count"), F.when(k % 9 == 0, line == 3).alias("limited"),
    )
    return bl.batch_visibility(made, "batch")


def _at(values: list[str], index: str) -> str:
    return f"({_list(values)})[({index})::int + 1]"


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(_quoted(x) for x in r) + ")" for r in rows)


def _blocks_sql() -> str:
    limited, confirming = (", ".join(_quoted(x) for x in names) for names in (bl.LIMITED_FRAMES, bl.CONFIRMING_FRAMES))
    return f"""
WITH f(frame, concern, why, safer) AS (VALUES {_values([(k, *v) for k, v in bl.FRAMES.items()])}), c(confidence, label, note) AS (VALUES {_values([(k, *v) for k, v in bl.CONFIDENCE.items()])}),
e AS (SELECT event_id, CASE WHEN event_id % 23 <> 0 THEN {_at(SHOWN, f"event_id % {len(SHOWN)}")} END AS frame, CASE WHEN event_id % 4 <> 0 THEN {_at(TITLES, f"event_id % {len(TITLES)}")} END AS title, {_at(sev.LEVELS, "user_id % 5")} AS severity,
  {_at(REASONS, f"user_id % {len(REASONS)}")} AS reason, event_id % 3 = 0 AND user_id % 11 = 0 AS limited, event_id % 2 AS details FROM events),
d AS (SELECT event_id, frame, nullif(title, '') AS title, CASE WHEN limited OR coalesce(frame, '') IN ({limited}) OR reason LIKE 'PDF_%' THEN 'limited_analysis'
  WHEN severity IN ('high', 'critical') AND (coalesce(frame, '') IN ({confirming}) OR (details > 0 AND reason <> 'FRAMES_DEFAULT_APPLIED')) THEN 'confirmed' ELSE 'inferred' END AS confidence FROM e)
SELECT event_id, d.confidence, coalesce(title, f.concern, g.concern) AS primary_concern, coalesce(f.why, g.why) AS why_this_matters, label, note, coalesce(f.safer, g.safer) AS safer_option
FROM d LEFT JOIN f ON d.frame = f.frame JOIN c ON d.confidence = c.confidence JOIN f g ON g.frame = '{bl.GENERAL}'"""


BATCH_SQL = f"""
WITH m AS (SELECT l_orderkey AS batch, {_at(["none", "low", "none", "low", "none", "medium", "none"], "(l_orderkey + l_linenumber) % 7")} AS severity, {_at(ESCALATIONS, "(l_orderkey * 3 + l_linenumber) % 7")} AS escalation,
  CASE WHEN l_orderkey % 6 <> 0 THEN CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN 'interrupt' ELSE 'notice' END END AS visibility, CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber % 2 ELSE 0 END AS signals, l_orderkey % 9 = 0 AND l_linenumber = 3 AS limited FROM lineitem)
SELECT batch, count(*) AS files, CASE WHEN NOT bool_or(limited OR severity = 'medium' OR signals > 0 OR escalation = 'modal' OR coalesce(visibility = 'interrupt', FALSE)) AND coalesce(bool_or(visibility = 'notice'), FALSE) THEN 'notice' ELSE 'interrupt' END AS visibility FROM m GROUP BY batch"""


def queries() -> dict[str, Query]:
    return {"quality_blocks": quality_blocks, "batch_visibility": batch_visibility}


def oracle_sql() -> dict[str, str]:
    return {"quality_blocks": _blocks_sql(), "batch_visibility": BATCH_SQL}
