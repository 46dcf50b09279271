"""Texts that arrive in pieces: put together into overlapping chunks, scanned once, dropped when superseded.

A source (a user, a session) has one scan at a time. Its pieces may come over many micro-batches and out
of order; the state holds the text that no chunk is complete for yet, at most a chunk and its overlap
once pieces are in order, so a finding across a batch boundary lies whole in some chunk. A request that
starts later takes the source's place: the state of the older one goes, and so do its later pieces. State
and timers live in the state store, so a restarted query goes on in the middle of a text.

The scan itself is the batch one, expressions over columns; only the putting together is stateful.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import texts

#: Pieces of requests: all of a request share started, n counts from 0, the last one says so; a null piece cancels.
PIECES = "source string, request_id string, started timestamp, n int, piece string, last boolean, ts timestamp"
CHUNKS = "source string, request_id string, ts timestamp, state string, start long, chunk string"

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rechunker(StatefulProcessor):
    """One row for each complete chunk (state ``chunk``) and one where a request ends: ``done``, ``canceled`` or ``expired``."""

    def __init__(self, size: int, overlap: int, idle_ms: int):
        self.size, self.overlap, self.idle_ms = size, overlap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "request_id string, started long, done boolean, next int, start long, held string, waits int, timer long")
        self.waiting = handle.getMapState("waiting", "n int", "piece string, last boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        active = self.active.get() if self.active.exists() else None
        old_timer = active[7] if active else None
        newest = 0
        for row in sorted(rows, key=lambda r: (r.ts, r.started, r.request_id, -1 if r.n is None else r.n)):
            at, newest = _millis(row.started), max(newest, _millis(row.ts))
            if active is None or (at, row.request_id) > (active[1], active[0]):
                if active is not None and not active[2]:
                    yield self._row(key, active, row.ts, "canceled")
                active = self._cleared(active, (row.request_id, at, False, 0, 0, "", 0))
            if active[0] != row.request_id or active[2]:
                continue  # of an older request, or of one that has ended
            if row.piece is None:
                yield self._row(key, active, row.ts, "canceled")
                active = self._cleared(active, (*active[:2], True, active[3], active[4], "", 0))
                continue
            if row.n is None or row.n < active[3]:
                continue  # no place in the text, or a repeated piece
            request, begun, done, expected, start, held, waits = active[:7]
            if row.n > expected:  # the map holds pieces that wait for their turn only
                if not waits or not self.waiting.containsKey((row.n,)):
                    waits += 1
                self.waiting.updateValue((row.n,), (row.piece, bool(row.last)))
            piece, last = (row.piece, bool(row.last)) if row.n == expected else (None, False)
            while piece is not None:
                expected, held = expected + 1, held + piece
                while len(held) >= self.size + self.overlap or (last and held):
                    yield Row(source=key[0], request_id=request, ts=row.ts, state="chunk", start=start, chunk=held[: self.size + self.overlap])
                    start, held = start + min(self.size, len(held)), held[self.size :]
                done, piece = last, None
                if waits and not done and self.waiting.containsKey((expected,)):
                    piece, last = self.waiting.getValue((expected,))
                    self.waiting.removeKey((expected,))
                    waits -= 1
            active = (request, begun, done, expected, start, held, waits)
            if done:
                active = self._cleared(active, (*active[:6], 0))
                yield self._row(key, active, row.ts, "done")
        timer = max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        if old_timer:
            self.handle.deleteTimer(old_timer)
        self.handle.registerTimer(timer)
        self.active.update((*active[:7], timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        active = self.active.get() if self.active.exists() else None
        self.active.clear()
        self.waiting.clear()
        if active is not None and not active[2]:
            # no earlier than the watermark, as rows for further stateful operators must be
            at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            yield self._row(key, active, datetime.datetime.fromtimestamp(at / 1000), "expired")

    def close(self) -> None:
        pass

    def _cleared(self, active: tuple | None, then: tuple) -> tuple:
        """``then``, after pieces that wait for ``active`` are gone; a call of the state store costs more than asking."""
        if active is not None and active[6]:
            self.waiting.clear()
        return then

    @staticmethod
    def _row(key, active: tuple, ts, state: str) -> Row:
        return Row(source=key[0], request_id=active[0], ts=ts, state=state, start=active[4], chunk=None)


def _millis(ts) -> int:
    return int(ts.timestamp() * 1000)


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Queries started from now on keep their state where processors need it."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def chunk_stream(pieces: DataFrame, size: int = texts.CHUNK, overlap: int = texts.OVERLAP, idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Chunks and ends of requests from a stream of PIECES, in CHUNKS; append mode, RocksDB state.

    A request without pieces for ``idle`` of event time expires: what it holds is dropped unscanned.
    Empty texts are done without a chunk. Rows without a source, request, start or time are dropped.
    """
    whole = pieces.dropna(subset=["source", "request_id", "started", "ts"]).withWatermark("ts", late)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return whole.groupBy("source").transformWithState(Rechunker(size, overlap, idle_ms), CHUNKS, "Append", "EventTime", eventTimeColumnName="ts")


def findings(chunks: DataFrame) -> DataFrame:
    """Findings of the chunks, each once: source, request_id, ts, id, type, severity, offset, matched.

    A finding between two chunks lies in both; the second one is dropped while it is within the watermark.
    """
    found = texts.found_in_chunks(chunks.where("state = 'chunk'"), ("source", "request_id", "ts"))
    return found.dropDuplicatesWithinWatermark(["source", "request_id", "id", "offset"])


def request_states(chunks: DataFrame) -> DataFrame:
    """How many requests of each source were done, canceled and expired."""
    return chunks.where("state <> 'chunk'").groupBy("source", "state").count()
