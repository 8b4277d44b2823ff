import json

from citewell.streaming.sessions import question_stream, with_history


def test_history_is_capped_and_redacted(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"session_id": "s", "query": f"question {k}"} for k in range(3)] + [{"session_id": "s", "query": "mail a.b@c.example"}]
    for k, x in enumerate(lines):
        (folder / f"{k}.json").write_text(json.dumps(x) + "\n")
        rows = with_history(question_stream(spark, str(folder)), 2, idle_ms=None)
        out = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        out.trigger(availableNow=True).start().awaitTermination()
    found = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.seq)
    assert [r.seq for r in found] == [0, 1, 2, 3]
    assert found[3].history == ["question 1", "question 2"]
    assert found[3].redacted_query == "mail [REDACTED:EMAIL]" and found[3].action == "refuse_pii"
