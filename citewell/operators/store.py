"""The chunk store: versioned Parquet snapshots, their statistics and fingerprints.

For a batch that isn't empty, deleting what is stale and writing what is new is
replacing the snapshot by the batch; an empty batch leaves the snapshot as it is.

A version is a folder of its own, numbered in order, and counts from the moment that
an empty marker file exists beside its rows. Creating that file is the only step that
changes what readers see: a crash at any point leaves the last version in place.
Nothing is deleted by a write, so readers keep the files of the version that they
opened; ``vacuum`` removes old versions and what crashes have left.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citewell import ship
from citewell.errors import ConfigError
from citewell.operators.durable import shared_dir

VERSION, MARKER = "v-", "_COMMITTED"
FLAT = ("chunk_id", "scheme_id", "scheme_name", "category", "plan", "section", "source_url", "fetched_at")


def first_by_id(batch: DataFrame, position: str, key: str = "chunk_id") -> DataFrame:
    """The first row of each id in the batch's order."""
    order = W.partitionBy(key).orderBy(position)
    return batch.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def stale(existing: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Stored rows that the batch doesn't have."""
    return existing.join(batch.select(key), key, "left_anti")


def snapshot(existing: DataFrame, batch: DataFrame, position: str, key: str = "chunk_id") -> DataFrame:
    """What is stored after the upsert. An empty batch is looked for at most once."""
    return existing if batch.isEmpty() else first_by_id(batch, position, key).select(*existing.columns)


def merge_report(existing: DataFrame, batch: DataFrame, key: str = "chunk_id", value: str = "content_sha256") -> DataFrame:
    """One row: inserted, updated, unchanged and deleted ids."""
    old = existing.groupBy(key).agg(F.max(value).alias("_old"), F.lit(True).alias("_had"))
    new = batch.groupBy(key).agg(F.max(value).alias("_new"), F.lit(True).alias("_has"))
    both = old.join(new, key, "full_outer")
    had, has = F.col("_had").isNotNull(), F.col("_has").isNotNull()
    same = F.col("_old").eqNullSafe(F.col("_new"))
    count = lambda c: F.count_if(c).cast("bigint")
    return both.agg(
        count(~had & has).alias("inserted"),
        count(had & has & ~same).alias("updated"),
        count(had & has & same).alias("unchanged"),
        count(had & ~has).alias("deleted"),
    )


def unchanged(existing: DataFrame, batch: DataFrame, key: str = "chunk_id", value: str = "content_sha256") -> DataFrame:
    """Rows of the batch that need no new vector: stored with the same content."""
    return batch.join(existing.select(key, value), [key, value], "left_semi")


class Store:
    """A folder of versions on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if not path:
            raise ConfigError("a store needs a path")

    def _fs(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def folders(self) -> list[str]:
        """All folders of versions, whole or not, in order."""
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()]
        return sorted(n for n in names if n.startswith(VERSION))

    def versions(self) -> list[str]:
        """Those that count, in order."""
        found = []
        for name in self.folders():
            fs, marker = self._fs(f"{name}/{MARKER}")
            if fs.exists(marker):
                found.append(name)
        return found

    def current(self) -> str | None:
        return next(reversed(self.versions()), None)

    def read(self, version: str | None = None) -> DataFrame | None:
        version = version or self.current()
        return None if version is None else self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, batch: DataFrame, position: str | None = None, key: str = "chunk_id", force: bool = False) -> bool:
        """Replace the snapshot by the batch; False if the batch is empty, which
        leaves the store as it is, or empty if ``force`` is given."""
        if batch.isEmpty() and not force:
            return False
        rows = batch if position is None else first_by_id(batch, position, key)
        self.commit(self.stage(rows))
        return True

    def stage(self, rows: DataFrame) -> str:
        """Write the rows as a version that doesn't count yet; its name."""
        last = next(reversed(self.folders()), f"{VERSION}{0:012d}")
        version = f"{VERSION}{int(last[len(VERSION) :].partition('-')[0]) + 1:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        return version

    def commit(self, version: str) -> None:
        fs, marker = self._fs(f"{version}/{MARKER}")
        fs.create(marker, False).close()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` versions, and older folders that never came
        to count; the names removed. Run it when nothing reads or writes these."""
        counted = self.versions()
        kept = counted[-max(keep, 1) :]
        gone = [n for n in self.folders() if n not in kept and kept and n < kept[-1]]
        for name in gone:
            fs, path = self._fs(name)
            fs.delete(path, True)
        return gone


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, stored: lineage ends there."""
    base = shared_dir(rows.sparkSession)
    if not rows.sparkSession.sparkContext.getCheckpointDir():
        rows.sparkSession.sparkContext.setCheckpointDir(base)
    return rows.checkpoint()


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """Eleven scalars of each chunk, flags as words, missing text empty."""
    return chunks.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FLAT),
        F.coalesce(F.col("chunk_index").try_cast("int"), F.lit(0)).alias("chunk_index"),
        F.when(F.coalesce("is_table", F.lit(False)), "true").otherwise("false").alias("is_table"),
        F.coalesce("content_sha256", F.lit("")).alias("content_sha256"),
    )


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """count, max_fetched_at (blanks aside) and schemes in order."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    return chunks.agg(
        F.count(F.lit(1)).alias("count"),
        F.max(given("fetched_at")).alias("max_fetched_at"),
        F.array_sort(F.collect_set(given("scheme_id"))).alias("schemes"),
    )


def max_fetched_at(chunks: DataFrame) -> str | None:
    return chunks.agg(F.max(F.when(F.col("fetched_at") != "", F.col("fetched_at")))).first()[0]


def corpus_fingerprint(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """fingerprint: twelve digits of the hash of all ids in order, "" if there are none.

    A hash of one long string takes it in order, so one task sorts the ids (it may
    spill) and streams them into the hash; ``set_fingerprint`` needs neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            digest.update("".join(batch.column("id").to_pylist()).encode())
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"fingerprint": [digest.hexdigest()[:12] if n else ""]})

    ship()
    ids = chunks.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL")
    found = ids.repartition(1).sortWithinPartitions("id").mapInArrow(run, "fingerprint string")
    return found.agg(F.coalesce(F.max("fingerprint"), F.lit("")).alias("fingerprint"))


def set_fingerprint(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A fingerprint of the same ids that partial sums make, for corpora of any size."""
    each = F.xxhash64(F.col(key).cast("string"))
    parts = F.concat_ws(
        "|", F.count(key).cast("string"), F.bit_xor(each).cast("string"), F.bit_xor(F.xxhash64(each)).cast("string")
    )
    return chunks.agg(F.substring(F.sha2(parts, 256), 1, 12).alias("fingerprint"))


def is_empty(chunks: DataFrame | None) -> bool:
    """What can't be read counts as empty."""
    try:
        return chunks is None or chunks.isEmpty()
    except Exception:  # noqa: BLE001  any reader's failure
        return True


def prefix(text: Column, n: int = 12) -> Column:
    return F.substring(text, 1, n)
