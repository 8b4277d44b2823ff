"""Registered queries of the store of buckets: merges that insert, update and delete, what
changed between versions, and statistics kept in the manifest, all against SQL over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.operators import durable
from citewell.operators.buckets import BucketStore
from citewell.queries import query, table


def merged(spark, d) -> tuple[BucketStore, int, int]:
    """All documents but those of one id in ten; then these, with new texts for one in seven
    and without one in eleven. The store and the numbers of its two versions."""
    docs: DataFrame = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_sha256"), F.col("source").alias("scheme_id"), F.col("lang").alias("fetched_at")
    )
    store = BucketStore(spark, durable.place(spark, "store"))
    first = store.write(docs.where("chunk_id % 10 <> 3"))
    sha = F.when(F.col("chunk_id") % 7 == 0, F.sha2("content_sha256", 256)).otherwise(F.col("content_sha256"))
    batch = docs.where("(chunk_id % 10 = 3 OR chunk_id % 7 = 0) AND chunk_id % 11 <> 5").withColumn("content_sha256", sha)
    second = store.merge(batch, docs.where("chunk_id % 11 = 5").select("chunk_id"))
    return store, first.number, second.number


_NEW = """
new AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN sha256(sha256(text)) ELSE sha256(text) END AS content_sha256, source AS scheme_id, lang AS fetched_at
        FROM documents WHERE doc_id % 11 <> 5)
"""


@query(f"WITH {_NEW} SELECT * FROM new")
def store_merge(spark, d):
    store, _, last = merged(spark, d)
    return store.read(store.version(last))


@query(
    "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 11 = 5 THEN 'deleted' WHEN doc_id % 10 = 3 THEN 'inserted' ELSE 'updated' END AS change FROM documents "
    "WHERE CASE WHEN doc_id % 11 = 5 THEN doc_id % 10 <> 3 ELSE doc_id % 10 = 3 OR doc_id % 7 = 0 END"
)
def store_changes(spark, d):
    store, first, last = merged(spark, d)
    return store.changes(store.version(first), store.version(last))


@query(f"WITH {_NEW} SELECT count(*) AS count, max(fetched_at) AS max_fetched_at, list_sort(list(DISTINCT scheme_id)) AS schemes FROM new")
def store_stats(spark, d):
    store, _, last = merged(spark, d)
    return store.stats(store.version(last))
