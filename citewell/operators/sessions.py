"""Session memory: the last turns of each session, redacted only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citewell.config import Settings


def last_turns(turns: DataFrame, n: int = Settings.max_history_turns, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """The last ``n`` turns of each session, oldest first by ``seq``; none for 0."""
    order = W.partitionBy(session).orderBy(F.col(seq).desc())
    return turns.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def record(answers: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """The turn that each answer leaves: the redacted question, never the raw one.
    Answers that failed before they were enforced leave none."""
    recorded = answers.where(F.col("recorded")) if "recorded" in answers.columns else answers
    return recorded.select(
        session, seq,
        F.col("guard.redacted_query").alias("redacted_query"),
        "kind", "generation_mode",
        F.transform("citations", lambda c: c["url"]).alias("citation_urls"),
    )
