"""Registered queries of the vector index: exact search by lists against a full scan in SQL,
with and without a filter, and search of the chosen number of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.operators import durable
from citewell.operators.index import Index
from citewell.queries import _SIMS, _TOP, query, vectors


def found(spark, d, n: int, filter_by: str | None = None, **how):
    rows, asked = vectors(spark, d)
    index = Index.build(rows, durable.place(spark, "vectors"), key="vec_id", filter_by=filter_by)
    got = index.search(asked, n, exclude_self=True, **how)
    return got.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"WITH {_TOP} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM t")
def index_exact(spark, d):
    """Lists that could hold a better row are searched too: the rows of a full scan."""
    return found(spark, d, 24, exact=True)


@query(
    f"WITH {_SIMS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE label = q_label) WHERE rank <= 24) "
    "SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM t"
)
def index_filtered(spark, d):
    return found(spark, d, 24, filter_by="label", exact=True)


@query(None)
def index_probed(spark, d):
    """The nearest lists alone: nearly the rows of a full scan."""
    return found(spark, d, 10)
