"""Ingest as a stream: pages as they arrive, to sections, chunks, vectors and the store.

A page is the whole of its scheme: the chunks it gives replace those that the scheme had. Each
batch is one commit, which carries the stream's name and the batch's number, so a batch that is
run again after a failure changes nothing, whether it had been committed or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citewell.config import Settings
from citewell.operators.buckets import BucketStore, Version
from citewell.operators.chunking import chunk_documents
from citewell.operators.durable import clean, durable, made
from citewell.operators.encode import Loader
from citewell.operators.store import first_by_id
from citewell.plans.ingest import documents_of, embedded


def commit_pages(
    pages: DataFrame, manifest: DataFrame, store: BucketStore, s: Settings = Settings(), *, load: Loader | None = None,
    fetched_at: Column | None = None, stream: tuple[str, int] | None = None,
) -> Version | None:
    """Chunk, encode and store some pages (scheme_id, url, final_url, html, status, error), one
    a scheme. A page that fails leaves its scheme as it was; so does one without a chunk."""
    if stream and store.version().batches.get(stream[0], -1) >= stream[1]:
        return None
    docs, _ = documents_of(pages, manifest, s, fetched_at)
    rows = durable(first_by_id(embedded(chunk_documents(docs, s), load, s), "chunk_index"), "ingest-chunks")
    stored = store.read()
    gone = None
    if stored is not None:
        of = stored.select("chunk_id", "scheme_id").join(rows.select("scheme_id").distinct(), "scheme_id", "left_semi")
        gone = of.join(rows.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")
    return store.merge(rows, gone, stream=stream)


def ingest_stream(
    pages: DataFrame, manifest: DataFrame, store: BucketStore, checkpoint: str, s: Settings = Settings(), *, name: str = "ingest",
    load: Loader | None = None, fetched_at: Column | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Run ``commit_pages`` over a stream of pages. Of a scheme's pages in one batch the
    last by ``arrived`` counts, where the stream has that column."""

    def commit(batch: DataFrame, number: int) -> None:
        before = made()
        last = batch
        if "arrived" in batch.columns:
            newest = batch.groupBy(F.col("scheme_id").alias("_of")).agg(F.max("arrived").alias("_last"))
            last = batch.join(newest, (F.col("scheme_id") == F.col("_of")) & (F.col("arrived") == F.col("_last"))).drop("_of", "_last", "arrived")
        commit_pages(last, manifest, store, s, load=load, fetched_at=fetched_at, stream=(name, number))
        clean(store.spark, since=before)

    writer = pages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
