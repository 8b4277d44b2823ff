"""Questions as a stream. Session memory is keyed state: a capped list of redacted
turns that goes when a session has been idle for long enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citewell import ship
from citewell.config import Settings
from citewell.functions import guard

IDLE_MS = 3_600_000
OUT = "session_id string, seq bigint, redacted_query string, action string, history array<string>"
STATE = "seq bigint, history array<string>"


def question_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Questions from JSON files (session_id, query) as they arrive in a folder."""
    return spark.readStream.schema("session_id string, query string").json(folder)


def guarded_stream(questions: DataFrame) -> DataFrame:
    """session_id, action, redacted_query: no state yet, and no raw question."""
    rows = questions.withColumn("g", guard.classify("query"))
    return rows.select("session_id", F.col("g.action").alias("action"), F.col("g.redacted_query").alias("redacted_query"))


def with_history(questions: DataFrame, n: int = Settings.max_history_turns, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Each question with its number in the session and the turns before it.

    None keeps sessions for ever; triggers that run until the input is used up need
    it, since timeouts make Spark plan batches without end.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, history = state.get if state.exists else (0, [])
        history = list(history)
        for batch in batches:
            rows = []
            for action, text in zip(batch["action"], batch["redacted_query"], strict=True):
                rows.append((key[0], seq, text, action, list(history)))
                seq, history = seq + 1, ([*history, text][-n:] if n else [])
            yield pd.DataFrame(rows, columns=["session_id", "seq", "redacted_query", "action", "history"])
        state.update((seq, history))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    ship()
    grouped = guarded_stream(questions).groupBy("session_id")
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return grouped.applyInPandasWithState(step, OUT, STATE, "append", timeout)


def event_windows(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums of an event stream (ts, event_type, value)."""
    by = (F.window("ts", window), F.col("event_type"))
    return (
        events.withWatermark("ts", late)
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
