"""The vector index against a full scan."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citewell.operators import index as ix
from citewell.operators import retrieve

SCHEMA = "vec_id bigint, embedding array<float>, label string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters of vectors, a third of all rows equal, and rows without a vector."""
    rng = np.random.default_rng(5)
    centers = ix.unit(rng.normal(size=(12, 16)))
    rows = []
    for k in range(900):
        v = centers[0] if k % 3 == 0 else ix.unit((centers[k % 12] + 0.4 * rng.normal(size=16))[None])[0]
        rows.append((k, [float(x) for x in v], "ab"[k % 2] if k % 7 else None))
    rows += [(1000 + k, None, "a") for k in range(3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).persist()


def asked(vectors):
    return vectors.where("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def built(vectors, tmp_path_factory):
    return ix.Index.build(vectors, str(tmp_path_factory.mktemp("index") / "i"), key="vec_id", filter_by="label", lists=20)


def test_every_row_is_in_one_list(vectors, built):
    assert built.lists.count() == 900 and built.lists.select("vec_id").distinct().count() == 900
    assert {r["rows"] for r in built.table.collect()} and built.table.agg(F.sum("rows")).first()[0] == 900


def test_recall_of_the_chosen_lists(vectors, built):
    found = built.search(asked(vectors).drop("label").withColumn("label", F.lit(None).cast("string")), 10)
    true = retrieve.nearest(vectors, asked(vectors), 10, key="vec_id")
    floor = {r.query_id: r.f for r in true.groupBy("query_id").agg(F.min("similarity").alias("f")).collect()}
    hits = sum(r.similarity >= floor[r.query_id] - 1e-9 for r in found.collect())  # equal vectors tie
    assert hits / true.count() >= 0.9


@pytest.mark.parametrize("how", [{}, {"least": 0.3}, {"exclude_self": True}])
def test_exact_search_is_a_full_scan(vectors, built, how):
    questions = asked(vectors).withColumn("label", F.lit(None).cast("string"))
    assert rows_of(built.search(questions, 12, probes=2, exact=True, **how)) == rows_of(retrieve.nearest(vectors, questions, 12, key="vec_id", **how))


def test_filter_splits_and_hot_lists(vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "PART_ROWS", 40)  # the list of equal rows has many parts
    monkeypatch.setattr(ix, "QUESTIONS", 3)
    built = ix.Index.build(vectors, str(tmp_path / "i"), key="vec_id", filter_by="label", lists=8)
    assert built.table.agg(F.max("parts")).first()[0] >= 8
    got = built.search(asked(vectors), 12, probes=1, exact=True)
    assert rows_of(got) == rows_of(retrieve.nearest(vectors, asked(vectors), 12, key="vec_id", filter_by="label"))


def test_nothing_to_index_and_ragged_vectors(spark, vectors, tmp_path):
    none = ix.Index.build(vectors.limit(0), str(tmp_path / "none"), key="vec_id", filter_by="label")
    assert none.search(asked(vectors), 5).count() == 0
    ragged = spark.createDataFrame([(1, [1.0, 0.0, 0.0], None), (2, [1.0], None)], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="vectors of 1 to 3 numbers"):
        retrieve.nearest(ragged, asked(vectors).limit(1), 1, key="vec_id").collect()


def test_retrieve_through_an_index(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(f"c{k}", [float(x) for x in ix.unit(rng.normal(size=(1, 8)))[0]], f"s{k % 2}") for k in range(80)]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, scheme_id string")
    corpus = corpus.select("*", F.col("embedding").alias("body_embedding"), F.col("chunk_id").alias("section"), F.lit("t").alias("display_text"))
    questions = corpus.limit(5).select(F.col("chunk_id").alias("query_id"), "embedding", F.lit(None).cast("string").alias("scheme_id"))
    built = ix.Index.build(corpus, str(tmp_path / "i"), filter_by="scheme_id", lists=4)
    plain = retrieve.retrieve(questions, corpus).select("query_id", "chunk_id", "rank").collect()

    class Exact:
        search = staticmethod(lambda q, n, least: built.search(q, n, least=least, exact=True))

    assert sorted(map(tuple, retrieve.retrieve(questions, corpus, index=Exact).select("query_id", "chunk_id", "rank").collect())) == sorted(map(tuple, plain))


def test_products_are_tiled(vectors, built, monkeypatch):
    """Whatever the lists and questions, no product of them is over a tile; results stay."""
    whole = [rows_of(built.search(asked(vectors), 5, probes=6, exact=e, exclude_self=True)) for e in (False, True)]
    batch = pa.RecordBatch.from_pydict({"x": list(range(100))})
    assert [b.num_rows for b in ix.slices(batch, ix.TILE_BYTES // 8 // 30)] == [30, 30, 30, 10]
    monkeypatch.setattr(ix, "TILE_BYTES", 800)
    assert [rows_of(built.search(asked(vectors), 5, probes=6, exact=e, exclude_self=True)) for e in (False, True)] == whole
