"""An inverted-list index for vector search.

Centroids are fitted on a sample of bounded size (k-means, cosine); every row goes to the list
of its nearest centroid, and a list over ``PART_ROWS`` rows is split into parts, which are
always searched together. The lists are stored by list number, with a table of one row a
list: its centroid, its parts, and the least similarity of a row to the centroid.

How many lists a question needs depends on the vectors: of a bounded sample of rows the true
neighbours are found by a full scan, and ``probes`` is the least number of nearest lists that
holds a share of ``RECALL`` of them. It is stored with the lists.

A question meets the parts of its ``probes`` nearest lists by an equality join; there rows
are scored exactly, and each group passes on a question's best rows only. A list that many
questions ask for has its questions split, so no group holds more than ``PART_ROWS`` rows and
``QUESTIONS`` questions. With ``exact`` a second pass searches every list that could
still hold a better row: unit vectors in a list lie within an angle of its centroid, which
bounds their similarity to a question. The result is then that of a full scan.

What is broadcast is centroids: at most ``MOST_LISTS``, a parameter, whatever the rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citewell import ship
from citewell.operators.durable import durable
from citewell.operators.retrieve import TILE_BYTES, Best, matrix, nearest

#: Rows that centroids are fitted on (in expectation), and lists at most.
SAMPLE, MOST_LISTS = 100_000, 4096
ROUNDS, SEED = 10, 11
PART_ROWS, QUESTIONS = 20_000, 4096
#: Rows that probes are chosen by, their neighbours, and the share of these to be found.
TRIALS, NEIGHBOURS, RECALL = 256, 10, 0.95
#: Rounding that a bound must allow for.
SLACK = 1e-6


def slices(batch: pa.RecordBatch, numbers: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, so many at a time that ``numbers`` for each of them fit a tile."""
    step = max(1, TILE_BYTES // (8 * max(1, numbers)))
    return (batch.slice(a, step) for a in range(0, batch.num_rows, step))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(rows: DataFrame, lists: int | None = None, *, key: str, vector: str, sample: int = SAMPLE) -> np.ndarray:
    """Centroids, one a row. By default as many as the root of the number of rows."""
    given = rows.where(F.col(vector).isNotNull()).select(key, vector)
    n = given.count()
    if not n:
        return np.zeros((0, 0))
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS, n))
    drawn = given.where(_hashed(key, sample / n)).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=lists, maxIter=ROUNDS, seed=SEED, distanceMeasure="cosine").fit(drawn)
    return unit(np.array(model.clusterCenters(), dtype=np.float64))


def assigned(rows: DataFrame, centroids: np.ndarray, vector: str) -> DataFrame:
    """``rows`` with list (of the nearest centroid) and near (the similarity to it)."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, len(sent.value)):
                similar = unit(matrix(b.column(vector))) @ sent.value.T
                at = similar.argmax(axis=1)
                near = similar[np.arange(len(at)), at]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(near)], [*b.schema.names, "list", "near"])

    ship()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.where(F.col(vector).isNotNull()).mapInArrow(run, f"{schema}, list int, near double")


def _hashed(key: str, share: float) -> Column:
    """Whether a row is in a sample of that share."""
    whole = 1 << 32
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(whole)) < F.lit(min(whole, int(whole * share)))


def probes_for(rows: DataFrame, n: int, centroids: np.ndarray, *, key: str, vector: str, trials: int = TRIALS, recall: float = RECALL) -> int:
    """The least number of nearest lists that have that share of the neighbours of about
    ``trials`` of the ``n`` rows (key, vector, list)."""
    asked = rows.where(_hashed(key, trials / n)).select(F.col(key).alias("_trial"), F.col(vector).alias("_asked"))
    true = nearest(rows, asked, NEIGHBOURS, key=key, vector=vector, question="_trial", question_vector="_asked", exclude_self=True)
    found = true.join(rows.select(key, "list"), key).join(asked, "_trial").select("_asked", "list").toPandas()  # bounded by the trials
    if not len(found):
        return max(1, len(centroids))
    near = unit(np.stack(found["_asked"].to_numpy())) @ centroids.T
    own = near[np.arange(len(found)), found["list"].to_numpy()]
    ranks = (near > own[:, None]).sum(axis=1) + 1
    return int(np.quantile(ranks, recall, method="higher"))


@dataclass
class Index:
    """lists: key, vector, the filter's column if any, list, part. table: list, centroid, rows, parts, least, probes."""

    lists: DataFrame
    table: DataFrame
    key: str
    vector: str
    filter_by: str | None = None

    @staticmethod
    def build(
        rows: DataFrame, path: str, *, key: str = "chunk_id", vector: str = "embedding", filter_by: str | None = None,
        lists: int | None = None, sample: int = SAMPLE,
    ) -> Index:
        """Index every row that has a vector, in ``path``."""
        spark = rows.sparkSession
        side = rows.select(key, vector, *([filter_by] if filter_by else []))
        centroids = fit(side, lists, key=key, vector=vector, sample=sample)
        held = durable(assigned(side, centroids, vector), "index-rows")
        sizes = held.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.min("near").alias("least"))
        parts = F.ceil(F.col("rows") / PART_ROWS).cast("int")
        at = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, centroid array<double>")
        n = held.count()
        probes = probes_for(held, n, centroids, key=key, vector=vector) if n else 1
        table = at.join(sizes, "list").select("list", "centroid", "rows", parts.alias("parts"), "least", F.lit(probes).alias("probes"))
        table.write.parquet(f"{path}/table")
        table = spark.read.parquet(f"{path}/table")
        # One row a list.
        split = held.join(F.broadcast(table.select("list", "parts")), "list")
        part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.col("parts")).cast("int")
        stored = split.withColumn("part", part).drop("parts", "near").repartition("list", "part").sortWithinPartitions("list", "part")
        stored.write.parquet(f"{path}/lists")
        return Index.open(spark, path, key=key, vector=vector, filter_by=filter_by)

    @staticmethod
    def open(spark: SparkSession, path: str, *, key: str = "chunk_id", vector: str = "embedding", filter_by: str | None = None) -> Index:
        return Index(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/table"), key, vector, filter_by)

    def _probed(self, questions: DataFrame, question: str, vector: str, probes: int, beyond: bool) -> DataFrame:
        """A row for each question and list to search: the nearest ``probes`` lists, or with
        ``beyond`` those others that could hold a row above the question's floor."""
        spark = self.table.sparkSession
        at = self.table.orderBy("list").collect()  # at most MOST_LISTS rows
        numbers = np.array([r["list"] for r in at], dtype=np.int32)
        centers = np.array([r["centroid"] for r in at])
        angle = np.arccos(np.clip([r["least"] for r in at], -1, 1))
        sent = spark.sparkContext.broadcast((numbers, centers, angle))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, centers, angle = sent.value
            # A row meets all lists, and goes out once for each that is chosen.
            width = (len(numbers) if beyond else min(probes, len(numbers))) * (centers.shape[1] if len(numbers) else 0)
            for b in (b for whole in batches for b in slices(whole, len(numbers) + width)):
                if not len(numbers):
                    continue
                asked = matrix(b.column(vector))
                near = unit(asked) @ centers.T
                rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
                chosen = rank < probes
                if beyond:
                    apart = np.maximum(np.arccos(np.clip(near, -1, 1)) - angle[None, :], 0)
                    bound = np.cos(np.minimum(apart, np.pi)) * np.linalg.norm(asked, axis=1)[:, None]
                    floor = b.column("_floor").to_numpy(zero_copy_only=False)[:, None]
                    chosen = ~chosen & (bound >= floor - SLACK)
                q, k = np.nonzero(chosen)
                took = b.drop_columns(["_floor"]).take(pa.array(q)) if beyond else b.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(numbers[k])], [*took.schema.names, "list"])

        names = [f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema if f.name != "_floor"]
        return questions.mapInArrow(run, ", ".join([*names, "list int"]))

    def _scored(self, probed: DataFrame, n: int, question: str, vector: str, least: float | None, exclude_self: bool) -> DataFrame:
        """question, key, similarity: each group's best rows of each of its questions."""
        key, own, limit = self.key, self.vector, self.filter_by
        probed = durable(probed, "index-probed")
        blocks = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUESTIONS).cast("int").alias("_blocks"))
        sizes = F.broadcast(self.table.select("list", "parts").join(blocks, "list"))  # one row a list
        block = F.pmod(F.xxhash64(F.col(question).cast("string")), F.col("_blocks")).cast("int")
        asked = probed.join(sizes, "list").withColumn("_block", block)
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "_blocks")
        asked = asked.select(F.col(question).alias("_question"), F.col(vector).alias("_asked"), *([F.col(limit).alias("_limit")] if limit else []), "list", "part", "_block")
        rows = self.lists.join(sizes.select("list", "_blocks"), "list")
        rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        kinds = [probed.schema[question].dataType.simpleString(), self.lists.schema[key].dataType.simpleString()]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, keys = left["_question"].to_pylist(), right[key].to_pylist()
            best = Best(len(ids), n)
            if least is not None:
                best.floor[:] = least
            if len(ids) and len(keys):
                wanted, rows = matrix(left["_asked"]), matrix(right[own])
                only = left["_limit"].to_pylist() if limit else None
                labels = np.array(right[limit].to_pylist(), dtype=object) if limit else None
                places = defaultdict(list)
                for j, k in enumerate(keys if exclude_self else ()):
                    places[k].append(j)
                step = max(1, TILE_BYTES // (8 * len(keys)))
                for a in range(0, len(ids), step):
                    similar = wanted[a : a + step] @ rows.T
                    good = similar >= best.floor[a : a + step, None]
                    for q in range(len(similar)):
                        if limit and only[a + q] is not None:
                            good[q] &= labels == only[a + q]
                        if exclude_self:
                            good[q, places.get(ids[a + q], [])] = False
                    for q in np.flatnonzero(good.any(axis=1)).tolist():
                        best.add(a + q, similar[q], np.flatnonzero(good[q]), keys)
            out = [(ids[q], k, -s) for q, found in enumerate(best.rows) for s, k in found]
            columns = list(zip(*out, strict=True)) or [()] * 3
            types = [left.schema.field("_question").type, right.schema.field(key).type, pa.float64()]
            return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[question, key, "similarity"])

        ship()
        groups = ["list", "part", "_block"]
        return asked.groupBy(*groups).cogroup(rows.groupBy(*groups)).applyInArrow(run, f"`{question}` {kinds[0]}, `{key}` {kinds[1]}, similarity double")

    def search(
        self, questions: DataFrame, n: int, *, probes: int | None = None, question: str = "query_id", question_vector: str = "embedding",
        least: float | None = None, exact: bool = False, exclude_self: bool = False,
    ) -> DataFrame:
        """question, key, similarity, rank: the ``n`` best rows in each question's ``probes``
        nearest lists (by default as many as were chosen), ties by key; with ``exact``, of all rows."""
        lists = self.table.count()
        probes = probes or (self.table.agg(F.max("probes")).first()[0] or 1)
        columns = [question, question_vector, *([self.filter_by] if self.filter_by else [])]
        asked = questions.select(*columns).where(F.col(question_vector).isNotNull())
        order = W.partitionBy(question).orderBy(F.col("similarity").desc(), self.key)
        top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        score = lambda probed: self._scored(probed, n, question, question_vector, least, exclude_self)
        found = score(self._probed(asked, question, question_vector, probes, False))
        if not exact or probes >= lists:
            return top(found)
        found = durable(found, "index-found")
        last = top(found).where(F.col("rank") == n).select(F.col(question).alias("_q"), F.col("similarity").alias("_floor"))
        floor = F.coalesce("_floor", F.lit(-np.inf if least is None else least))
        more = asked.join(last, F.col(question) == F.col("_q"), "left").withColumn("_floor", floor).drop("_q")
        return top(found.unionByName(score(self._probed(more, question, question_vector, probes, True))))
