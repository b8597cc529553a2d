"""State of one's own per key: user sessions that event-time timers end."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, status string, n_events long, started timestamp, last_seen timestamp"
#: The same with times in microseconds, as the processor gives them.
MICROS = "key string, status string, n_events long, started long, last_seen long"
NAMES = ("key", "status", "n_events", "started", "last_seen")
STATE = "n_events long, started long, last_seen long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep their state in RocksDB, off the heap, as ``session_state`` needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def cut_sessions(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each session in ascending times: a new one begins more than ``gap`` after a time."""
    begins = np.flatnonzero(np.concatenate([[True], np.diff(times) > gap]))
    return begins, np.append(begins[1:], len(times)) - 1


class Sessions(StatefulProcessor):
    """A key's open session: number of events, first and last time in microseconds. Late events count in it, but move no bound back."""

    def __init__(self, ts: str, gap_seconds: int, ttl_ms: int | None):
        self.ts, self.gap, self.ttl_ms = ts, gap_seconds * 1_000_000, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE, self.ttl_ms)

    def _rows(self, key: tuple, found: list[tuple[str, int, int, int]]) -> pd.DataFrame:
        status, n, first, last = zip(*found, strict=True)
        return pd.DataFrame({"key": str(key[0]), "status": status, "n_events": n, "started": pd.to_datetime(first, unit="us"), "last_seen": pd.to_datetime(last, unit="us")})

    def _out(self, key: tuple, found: list[tuple[str, int, int, int]]) -> Iterator[pd.DataFrame]:
        yield self._rows(key, found)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._out(key, self._step(np.concatenate([b[self.ts].to_numpy("datetime64[us]").astype(np.int64) for b in rows]), timerValues))

    def _step(self, times: np.ndarray, timerValues) -> list[tuple[str, int, int, int]]:
        """Status, number and bounds of the sessions that these times end or leave open."""
        times = np.sort(times)
        n, first, last = held = self.open.get() or (0, None, None)
        # events up to a gap after the open session's end belong to it, late ones too
        own = int(np.searchsorted(times, last + self.gap, "right")) if n else 0
        if own:
            apart = np.flatnonzero(np.diff(times[own - 1 :]) > self.gap)
            own = own + int(apart[0]) if len(apart) else len(times)
        found = []
        if n:
            n, last = n + own, max(last, int(times[own - 1])) if own else last
            if own < len(times):
                found.append(("ENDED", n, first, last))
        if own < len(times):
            rest = times[own:]
            begins, ends = cut_sessions(rest, self.gap)
            each = [(int(e - b + 1), int(rest[b]), int(rest[e])) for b, e in zip(begins, ends, strict=True)]
            found += [("ENDED", *x) for x in each[:-1]]
            n, first, last = each[-1]
        self.open.update((n, first, last))
        if held[0]:  # each call is a round trip, and a key without a session has no timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last // 1000 + self.gap // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return [*found, ("ACTIVE", n, first, last)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        if held:
            self.open.clear()
            yield from self._out(key, [("ENDED", *held)])

    def close(self) -> None:
        pass


class RowSessions(Sessions):
    """The same over plain rows, with times in microseconds: a key costs no frames."""

    def _out(self, key: tuple, found: list[tuple[str, int, int, int]]) -> Iterator[Row]:
        for x in found:
            yield Row(**dict(zip(NAMES, (str(key[0]), *x), strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._out(key, self._step(np.array([r[self.ts] for r in rows], dtype=np.int64), timerValues))


def session_state(df: DataFrame, key: str, ts: str, gap_seconds: int, delay: str = "1 minute", ttl_ms: int | None = None) -> DataFrame:
    """ACTIVE after each batch in which a key had events, ENDED once the watermark is ``gap_seconds`` past the last.

    An event later than the gap after the last one ends the session and starts another. State lives in the store of
    ``state_store``, which the stream must start with; a timer removes it, or ``ttl_ms`` of processing time where
    that is given. A batch's events of a key are cut into sessions as arrays, not row by row. Events without a time are in none.
    """
    at = "__at" if "__at" not in (key, ts) else "__at_us"
    timed = df.withWatermark(ts, delay).filter(F.col(f"`{ts}`").isNotNull()).select(f"`{key}`", f"`{ts}`", F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias(at))
    made = timed.groupBy(key).transformWithState(RowSessions(at, gap_seconds, ttl_ms), MICROS, "Append", "EventTime")
    return made.withColumns({c: F.timestamp_micros(c) for c in ("started", "last_seen")})
