"""Session memory as a stateful processor: the last turns in a list state with a time to
live, and a timer that forgets a session that has been idle.

It needs the RocksDB state store (``STORE`` as ``spark.sql.streaming.stateStore.providerClass``).
A batch's rows of one session go by their order of arrival; state has redacted turns alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citewell import ship
from citewell.config import Settings
from citewell.streaming.sessions import IDLE_MS, OUT, guarded_stream

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionMemory(StatefulProcessor):
    """Gives each question its number in the session and the turns before it, ``n`` at most."""

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "text string", self.idle_ms)
        self.count = handle.getValueState("count", "seq bigint", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        history = [t[0] for t in self.turns.get()] if self.turns.exists() else []
        seq = self.count.get()[0] if self.count.exists() else 0
        for batch in rows:
            out = []
            for action, text in zip(batch["action"], batch["redacted_query"], strict=True):
                out.append((key[0], seq, text, action, list(history)))
                seq, history = seq + 1, ([*history, text][-self.n :] if self.n else [])
            yield pd.DataFrame(out, columns=["session_id", "seq", "redacted_query", "action", "history"])
        self.turns.put([(t,) for t in history]) if history else self.turns.clear()
        self.count.update((seq,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The session has been idle: its memory goes, and nothing is given out."""
        self.turns.clear()
        self.count.clear()
        return iter([])

    def close(self) -> None:
        pass


def with_memory(questions: DataFrame, n: int = Settings.max_history_turns, idle_ms: int = IDLE_MS) -> DataFrame:
    """session_id, seq, redacted_query, action and history of a stream of questions (session_id, query)."""
    ship()
    grouped = guarded_stream(questions).groupBy("session_id")
    return grouped.transformWithStateInPandas(
        statefulProcessor=SessionMemory(n, idle_ms), outputStructType=OUT, outputMode="append", timeMode="processingTime"
    )
