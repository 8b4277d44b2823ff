"""Ingest as a stream ends where a batch over the same pages does, and replays change nothing."""

from pyspark.sql import functions as F

from citewell.config import Settings
from citewell.operators.buckets import BucketStore
from citewell.schemas import PAGE
from citewell.streaming.ingest import commit_pages, ingest_stream

S = Settings(dimensions=16, min_page_chars=50)


def page(k, text):
    html = f"<main><h1>Title {k}</h1><p>" + f"{text} of scheme {k} is {k}.5% here. " * 30 + "</p></main>"
    return (f"s{k}", f"https://x.example/{k}", f"https://x.example/{k}", html, 200, None)


def manifest_of(spark):
    rows = [(f"s{k}", f"N{k}", "c", "p", f"https://x.example/{k}") for k in range(8)]
    return spark.createDataFrame(rows, "scheme_id string, scheme_name string, category string, plan string, url string")


def content(store):
    return sorted((r.chunk_id, r.display_text, tuple(r.embedding)) for r in store.read().collect())


def test_stream_equals_batch_and_replay_is_nothing(spark, tmp_path):
    pages, manifest = tmp_path / "pages", manifest_of(spark)
    put = lambda rows: spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(str(pages))
    streamed = BucketStore(spark, str(tmp_path / "streamed"), buckets=8)

    def run():
        stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(str(pages))
        ingest_stream(stream, manifest, streamed, str(tmp_path / "checkpoint"), S, fetched_at=F.lit("2026-01-31")).awaitTermination()

    first = [page(k, "The rate") for k in range(5)] + [("s6", "u", None, None, None, "status 503")]
    put(first)
    run()
    assert streamed.version().batches == {"ingest": 0} and streamed.version().number == 1
    second = [page(2, "Another rate"), page(7, "The rate")]
    put(second)
    run()
    last = streamed.version()
    assert last.batches == {"ingest": 1} and last.number == 2

    batch = BucketStore(spark, str(tmp_path / "batch"), buckets=8)
    whole = [p for p in first if p[0] != "s2"] + second
    commit_pages(spark.createDataFrame(whole, PAGE), manifest, batch, S, fetched_at=F.lit("2026-01-31"))
    assert content(streamed) == content(batch) and batch.version().fingerprint == last.fingerprint

    again = commit_pages(spark.createDataFrame(second, PAGE), manifest, streamed, S, fetched_at=F.lit("2026-01-31"), stream=("ingest", 1))
    assert again is None and streamed.version() == last
    run()  # nothing new has arrived
    assert streamed.version() == last
    other = commit_pages(spark.createDataFrame(second, PAGE), manifest, streamed, S, fetched_at=F.lit("2026-01-31"), stream=("other", 0))
    assert other.buckets == last.buckets and other.batches == {"ingest": 1, "other": 0}
