"""The same operators on streams: scan events, last-write-wins debouncing, deduplication, windowed risk rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import normalize as nz
from ..operators import scan, severity

LEAST_TEXT = 20
EVENTS = "request_id string, source string, text string, ts timestamp"


def scan_stream(events: DataFrame) -> DataFrame:
    """Findings of each event with at least 20 characters of text: request_id, ts and the signal's fields. Stateless."""
    ready = events.where(F.length("text") >= LEAST_TEXT)
    return scan.scan(nz.normalized(ready), keep=["request_id", "ts"])


def first_findings(signals: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each finding of a request once within the watermark."""
    return signals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id", "pattern_id", "matched"])


def debounced(events: DataFrame, quiet: str = "200 milliseconds", late: str = "10 minutes") -> DataFrame:
    """The last event of each burst: a session of a source's events with gaps under ``quiet`` is one scan."""
    sessions = events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), "source")
    last = sessions.agg(F.max_by(F.struct("request_id", "text", "ts"), "ts").alias("e"), F.count(F.lit(1)).alias("events"))
    return last.select("source", "e.request_id", "e.text", "e.ts", "events")


def risk_rates(signals: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Findings by type in tumbling windows, and the worst severity among them."""
    return signals.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count(F.lit(1)).alias("findings"), severity.level(F.max(severity.rank(F.col("severity")))).alias("any_severity"))


def latest_request(events: DataFrame, timeout: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Running count of each source's events and the newest request: older ones are cancelled.

    The state is one row a source and goes when the watermark is ``timeout`` past its last event.
    """
    millis = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, newest, at = state.get if state.exists else (0, "", 0)
        for part in parts:
            n += len(part)
            row = part.sort_values(["ts", "request_id"]).iloc[-1]
            if row["ts"].value >= at:
                newest, at = row["request_id"], row["ts"].value
        state.update((n, newest, at))
        state.setTimeoutTimestamp(max(at // 1_000_000, state.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame({"source": [key[0]], "events": [n], "request_id": [newest]})

    return events.withWatermark("ts", late).groupBy("source").applyInPandasWithState(step, "source string, events long, request_id string", "n long, newest string, at long", "update", GroupStateTimeout.EventTimeTimeout)
