"""Failed attempts of queued rows as keyed state: a count, quarantine after too many, release by hand, expiry by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger_ops import QUARANTINE_AFTER

RESULT = "key string, attempts long, quarantined boolean, reason string, event string"
#: A key without news for so long is forgotten; a quarantined one never is.
FORGET_MS = 7 * 86_400_000


class Attempts(StatefulProcessor):
    """The state of one key: its failed attempts so far, and why it is in quarantine."""

    def __init__(self, most: int = QUARANTINE_AFTER, forget_ms: int = FORGET_MS):
        self.most, self.forget_ms = most, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "attempts long, reason string, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, reason, timer = self.state.get() if self.state.exists() else (0, None, 0)
        events = pd.concat(list(rows)).sort_values("at", kind="stable")
        event, now = None, int(events["at"].max().timestamp() * 1000)
        for kind, why in zip(events["kind"], events["error"]):
            if kind == "release":
                attempts, reason, event = 0, None, "released"
            elif reason is not None:  # a quarantined row isn't tried
                event = event or "quarantined"
            elif kind == "done":
                attempts, event = 0, "done"
            elif kind == "own page":
                attempts, reason, event = self.most + 1, str(why), "quarantined"
            else:
                attempts += 1
                event = "failed"
                if attempts > self.most:
                    reason, event = str(why), "quarantined"
        if timer:
            self.handle.deleteTimer(timer)
        timer = 0
        if event == "done":
            self.state.clear()
        else:
            if reason is None:
                timer = now + self.forget_ms
                self.handle.registerTimer(timer)
            self.state.update((int(attempts), reason, int(timer)))
        yield pd.DataFrame({"key": [key[0]], "attempts": [attempts], "quarantined": [reason is not None], "reason": [reason], "event": [event]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "attempts": [0], "quarantined": [False], "reason": [None], "event": ["forgotten"]})

    def close(self) -> None:
        pass


def attempts(stream: DataFrame, most: int = QUARANTINE_AFTER, forget_ms: int = FORGET_MS, late: str = "1 hour") -> DataFrame:
    """A row for each key and micro-batch with news: (key, attempts, quarantined, reason, event).

    stream (key, at, kind, error): what happened to a row, in order of ``at``.  ``failed`` adds to its attempts, and the one after ``most`` puts it into quarantine; ``own page`` does so at
    once; ``done`` forgets it, unless it is in quarantine; ``release`` ends the quarantine and starts the count anew.  A key that fails and is
    never heard of again is forgotten after ``forget_ms``.  The session's state store must be RocksDB.
    """
    return stream.select("key", "at", "kind", "error").withWatermark("at", late).groupBy("key").transformWithStateInPandas(statefulProcessor=Attempts(most, forget_ms), outputStructType=RESULT, outputMode="Update", timeMode="EventTime")
