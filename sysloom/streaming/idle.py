"""Processing-time sessions: a run is complete when it has been silent too long.

State per run is a few numbers (never the events), so a run of any size keeps
bounded state.  Output rows tell how a session stands: ``open`` after each
batch that brought events, ``closed`` once the silence has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "detonation_id string, session long, package_name string, events long, status string"
_STATE = "session long, package_name string, events long, last_ms long"


class IdleSessions(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self._gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        session, package, events, _ = self._state.get() or (0, None, 0, now)
        for batch in rows:
            events += len(batch)
            package = batch["package_name"].iloc[batch["seq"].argmax()]
        self._state.update((session, package, events, now))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        # complete only after MORE than the gap
        self._handle.registerTimer(now + self._gap_ms + 1)
        yield self._row(key, session, package, events, "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, package, events, last = self._state.get()
        # a later event opens the next session under the same run
        self._state.update((session + 1, package, 0, last))
        yield self._row(key, session, package, events, "closed")

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, session, package, events, status) -> pd.DataFrame:
        return pd.DataFrame({"detonation_id": [key[0]], "session": [session], "package_name": [package],
                             "events": [events], "status": [status]})


def sessionize_idle(events: DataFrame, gap_seconds: float = 8.0) -> DataFrame:
    """Open and closed sessions of a stream by processing time (active view included)."""
    rows = events.select("detonation_id", "package_name", "seq")
    return rows.groupBy("detonation_id").transformWithStateInPandas(
        IdleSessions(int(gap_seconds * 1000)), OUTPUT, "Update", "processingTime")
