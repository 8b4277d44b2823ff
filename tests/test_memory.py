"""Session memory: the cap, what is redacted, a restart from the checkpoint, and expiry."""

import json
import time

import pytest

from citewell.streaming.memory import STORE, with_memory
from citewell.streaming.sessions import OUT, question_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, STORE)
    yield
    spark.conf.unset(PROVIDER)


class Run:
    """A query over a folder of questions, whose answers are waited for: timers make Spark plan
    batches without end, so there is no "all done"."""

    def __init__(self, spark, path, idle_ms):
        self.spark, self.path, self.idle_ms, self.sent = spark, path, idle_ms, 0
        (path / "in").mkdir()
        self.start()

    def start(self):
        rows = with_memory(question_stream(self.spark, str(self.path / "in")), 2, self.idle_ms)
        out = rows.writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "cp"))
        self.query = out.trigger(processingTime="1 second").start()

    def answers(self):
        there = (self.path / "out" / "_spark_metadata").exists()
        return self.spark.read.schema(OUT).parquet(str(self.path / "out")).collect() if there else []

    def ask(self, *questions):
        lines = [json.dumps({"session_id": s, "query": q}) for s, q in questions]
        (self.path / "in" / f"{self.sent}.json").write_text("\n".join(lines) + "\n")
        self.sent += len(questions)
        until = time.monotonic() + 60
        while len(self.answers()) < self.sent:
            assert time.monotonic() < until and self.query.isActive
            time.sleep(0.3)


def test_cap_and_restart(spark, rocks, tmp_path):
    run = Run(spark, tmp_path, 3_600_000)
    for k in range(3):
        run.ask(("s", f"question {k}"))
    run.query.stop()
    run.start()  # what it knew is in the checkpoint
    run.ask(("s", "mail a.b@c.example"), ("t", "other"))
    run.query.stop()
    found = {(r.session_id, r.seq): r for r in run.answers()}
    assert sorted(found) == [("s", 0), ("s", 1), ("s", 2), ("s", 3), ("t", 0)]
    assert found["s", 3].history == ["question 1", "question 2"] and found["t", 0].history == []
    assert found["s", 3].redacted_query == "mail [REDACTED:EMAIL]" and found["s", 3].action == "refuse_pii"


def test_an_idle_session_is_forgotten(spark, rocks, tmp_path):
    run = Run(spark, tmp_path, 2000)
    run.ask(("s", "before"))
    time.sleep(5)
    run.ask(("s", "after a while"))
    run.query.stop()
    assert [(r.seq, r.history) for r in run.answers() if r.redacted_query == "after a while"] == [(0, [])]
