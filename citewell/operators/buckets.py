"""A store that rewrites only what changed, refuses lost updates, and keeps its statistics.

Rows are dealt to ``BUCKETS`` buckets by a hash of their id. A version is a manifest with a row
for each bucket that has rows: where they are, how many, two hashes of their contents, two of
their ids, and the last date. A write computes the same of its rows, bucket by bucket, and
writes only the buckets whose content hashes differ; the new manifest takes the others over.

Manifests are numbered. The next number is taken by creating its file, which fails if it is
there: of two writers from one version the second gets ``ConflictError`` or, in ``write`` and
``merge``, starts again from what the first has committed. Counts, dates, schemes and the fingerprint
come from the manifest, never from rows, and two versions differ only in buckets
whose hashes do.

What the driver holds is the manifest: one row a bucket, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell.errors import ConfigError, ConflictError
from citewell.operators.durable import durable
from citewell.operators.store import first_by_id

BUCKETS = 256
DIGITS = 12
#: Seconds that a version's empty file may be a commit under way.
PATIENCE = 5.0
ATTEMPTS = 5


@dataclass(frozen=True)
class Bucket:
    """What a manifest has of a bucket; ``write`` names the folder of its rows."""

    write: str
    rows: int
    content: str
    ids: str
    last: str | None


@dataclass(frozen=True)
class Version:
    number: int
    columns: str
    buckets: dict[int, Bucket]
    #: The last batch that each named stream has committed.
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(b.rows for b in self.buckets.values())

    @property
    def max_fetched_at(self) -> str | None:
        return max((b.last for b in self.buckets.values() if b.last), default=None)

    @property
    def fingerprint(self) -> str:
        """Twelve digits of the hash of the buckets' id hashes; "" without rows."""
        tree = "".join(f"{k}:{b.rows}:{b.ids};" for k, b in sorted(self.buckets.items()))
        return hashlib.sha256(tree.encode()).hexdigest()[:DIGITS] if tree else ""


EMPTY = Version(0, "", {})


def differing(a: Version, b: Version) -> list[int]:
    """Buckets whose contents are not the same."""
    have = lambda v, k: v.buckets[k].content if k in v.buckets else None
    return sorted(k for k in a.buckets.keys() | b.buckets.keys() if have(a, k) != have(b, k))


class BucketStore:
    """Versions of rows that have an id (``key``), in a folder of any file system."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", date: str = "fetched_at", scheme: str = "scheme_id", buckets: int = BUCKETS):
        if not path:
            raise ConfigError("a store needs a path")
        self.spark, self.path, self.key, self.date, self.scheme, self.buckets = spark, path.rstrip("/"), key, date, scheme, buckets

    # Versions ---------------------------------------------------------------------------

    def _fs(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _put(self, name: str, text: str) -> None:
        """Create a file, which must not be there."""
        fs, path = self._fs(name)
        out = fs.create(path, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _get(self, name: str) -> str:
        fs, path = self._fs(name)
        data = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(fs.open(path))
        return bytes(data).decode()

    def numbers(self) -> list[int]:
        fs, path = self._fs("versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()) if fs.exists(path) else []

    def version(self, number: int | None = None) -> Version:
        """A version's manifest; by default the last. Without any, an empty one."""
        number = number or next(reversed(self.numbers()), 0)
        if not number:
            return EMPTY
        name, until = f"versions/{number:0{DIGITS}d}", time.monotonic() + PATIENCE
        while not (text := self._get(name)):
            if time.monotonic() > until:
                raise ConflictError(f"version {number} was begun and not finished; release({number}) gives it up")
            time.sleep(0.05)
        made = json.loads(self._get(f"manifests/{text}"))
        return Version(number, made["columns"], {int(k): Bucket(**b) for k, b in made["buckets"].items()}, made["batches"])

    def release(self, number: int) -> None:
        """Give up a version that a writer began and did not finish."""
        name = f"versions/{number:0{DIGITS}d}"
        if not self._get(name):
            fs, path = self._fs(name)
            fs.delete(path, False)

    def commit(self, base: Version, made: Version) -> Version:
        """``made`` as the version after ``base``; ``ConflictError`` if there is one."""
        name = f"{uuid.uuid4().hex}.json"
        buckets = {k: asdict(b) for k, b in made.buckets.items()}
        self._put(f"manifests/{name}", json.dumps({"columns": made.columns, "buckets": buckets, "batches": made.batches}))
        try:
            self._put(f"versions/{base.number + 1:0{DIGITS}d}", name)
        except Exception as e:
            if "exist" in str(e).lower():
                raise ConflictError(f"version {base.number + 1} has been committed by another writer") from e
            raise
        return replace(made, number=base.number + 1)

    # Rows -------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, or of some of its buckets; None if nothing was ever stored."""
        version = version or self.version()
        if not version.columns:
            return None
        schema = T.StructType.fromJson(json.loads(version.columns))
        some = [b for k, b in sorted(version.buckets.items()) if buckets is None or k in set(buckets)]
        paths = sorted({f"{self.path}/rows/{b.write}/bucket={k}" for k, b in version.buckets.items() if b in some and (buckets is None or k in set(buckets))})
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _measured(self, rows: DataFrame) -> dict[int, Bucket]:
        """Buckets of stored rows, without the folder that they will have."""
        columns = [F.col(f"`{c}`") for c in sorted(c for c in rows.columns if c != "bucket")]
        null = F.array(*(c.isNull() for c in columns))  # hashes pass over nulls
        hashed = lambda salt, *of: F.bit_xor(F.xxhash64(F.lit(salt), *of))
        date = F.max(F.when(F.col(self.date) != "", F.col(self.date))) if self.date in rows.columns else F.lit(None).cast("string")
        by = rows.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("rows"), hashed(1, null, *columns).alias("c1"), hashed(2, null, *columns).alias("c2"),
            hashed(1, F.col(self.key)).alias("i1"), hashed(2, F.col(self.key)).alias("i2"), date.alias("last"),
        )
        sign = lambda *xs: "".join(f"{x % (1 << 64):016x}" for x in xs)
        return {r.bucket: Bucket("", r.rows, f"{r['rows']}-{sign(r.c1, r.c2)}", sign(r.i1, r.i2), r.last) for r in by.collect()}

    def _stored(self, base: Version, rows: DataFrame, touched: list[int] | None = None) -> Version:
        """The version that has ``rows`` in all buckets, or in the ``touched`` ones: those
        whose contents are new are written."""
        rows = durable(rows.withColumn("bucket", self._bucket()), "store-batch")
        schema = T.StructType([f for f in rows.schema if f.name != "bucket"])
        found = self._measured(rows)
        columns = schema.json()
        same = {k for k, b in found.items() if base.columns == columns and k in base.buckets and base.buckets[k].content == b.content}
        new = sorted(found.keys() - same)
        write = uuid.uuid4().hex
        if new:
            changed = rows.where(F.col("bucket").isin(new))
            changed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/{write}")
            if self.scheme in schema.fieldNames():
                changed.select("bucket", self.scheme).distinct().write.parquet(f"{self.path}/schemes/{write}")
        kept = {k: b for k, b in base.buckets.items() if touched is not None and k not in set(touched)}
        made = {k: base.buckets[k] if k in same else Bucket(write, b.rows, b.content, b.ids, b.last) for k, b in found.items()}
        return Version(base.number, columns, kept | made, base.batches)

    def _again(self, once: Callable[[], Version | None], attempts: int) -> Version | None:
        for k in range(attempts):
            try:
                return once()
            except ConflictError:
                if k + 1 == attempts:
                    raise
        return None

    def write(self, batch: DataFrame, position: str | None = None, force: bool = False, attempts: int = ATTEMPTS) -> Version | None:
        """Make the batch what is stored; of rows with one id the first by ``position`` counts.
        An empty batch changes nothing (None), unless ``force`` empties the store."""
        if batch.isEmpty() and not force:
            return None
        rows = batch if position is None else first_by_id(batch, position, self.key)

        def once() -> Version:
            base = self.version()
            return self.commit(base, self._stored(base, rows))

        return self._again(once, attempts)

    def merge(
        self, batch: DataFrame, deleted: DataFrame | None = None, position: str | None = None, attempts: int = ATTEMPTS,
        stream: tuple[str, int] | None = None,
    ) -> Version | None:
        """Insert and update the batch's rows and take out the ids of ``deleted``; the rest
        stays. Only buckets that hold one of these ids are read. A schema must stay as it is.
        ``stream`` is a stream's name and the number of its batch: one that has been committed,
        or one before it, changes nothing (None)."""
        if stream and self.version().batches.get(stream[0], -1) >= stream[1]:
            return None
        rows = batch if position is None else first_by_id(batch, position, self.key)
        ids = rows.select(self.key) if deleted is None else rows.select(self.key).unionByName(deleted.select(self.key))
        ids = durable(ids.distinct(), "store-ids")
        touched = sorted(r[0] for r in ids.select(self._bucket().alias("b")).distinct().collect())  # at most all buckets
        if not touched:
            return None

        def once() -> Version | None:
            base = self.version()
            if stream and base.batches.get(stream[0], -1) >= stream[1]:
                return None
            old = self.read(base, touched)
            if old is None:
                made = self._stored(base, rows)
            else:
                whole = old.join(ids, self.key, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))
                made = self._stored(base, whole, touched)
            return self.commit(base, replace(made, batches=base.batches | dict([stream] if stream else [])))

        return self._again(once, attempts)

    # What versions know -----------------------------------------------------------------

    def stats(self, version: Version | None = None) -> DataFrame:
        """count, max_fetched_at and schemes in order, without reading a row."""
        version = version or self.version()
        live = [(b.write, k) for k, b in version.buckets.items()]
        one = self.spark.createDataFrame([(version.rows, version.max_fetched_at)], "count bigint, max_fetched_at string")
        fs, _ = self._fs()
        writes = sorted({w for w, _ in live if fs.exists(self._fs(f"schemes/{w}")[1])})
        if not writes:
            return one.withColumn("schemes", F.array().cast("array<string>"))
        made = self.spark.read.parquet(*(f"{self.path}/schemes/{w}" for w in writes))
        made = made.select("bucket", F.col(self.scheme).alias("s"), F.regexp_extract(F.input_file_name(), r"schemes/([0-9a-f]+)/", 1).alias("write"))
        counted = self.spark.createDataFrame(live, "write string, bucket int")
        schemes = made.join(counted, ["write", "bucket"], "left_semi").where("s <> ''").agg(F.array_sort(F.collect_set("s")).alias("schemes"))
        return one.join(schemes)

    def changes(self, before: Version, after: Version) -> DataFrame:
        """id and change (inserted, updated, deleted) between two versions, from the buckets
        whose hashes differ."""
        some = differing(before, after)
        shape = self.read(after if after.columns else before)
        none = self.spark.createDataFrame([], shape.schema)
        side = lambda v, name: (self.read(v, some) if v.columns else none).select(
            F.col(self.key).alias(f"_{name}"), F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(shape.columns)))), 256).alias(name)
        )
        both = side(before, "old").join(side(after, "new"), F.col("_old") == F.col("_new"), "full_outer")
        change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").otherwise("updated")
        return both.where("_old IS NULL OR _new IS NULL OR old <> new").select(F.coalesce("_old", "_new").alias(self.key), change.alias("change"))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` versions and the folders that these do not name;
        the names removed. Run it when nothing writes."""
        numbers = self.numbers()
        kept = numbers[-max(keep, 1) :]
        used = {b.write for n in kept for b in self.version(n).buckets.values()}
        gone = []
        for folder in ("rows", "schemes"):
            fs, path = self._fs(folder)
            names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
            gone += [f"{folder}/{n}" for n in names if n not in used]
        gone += [f"versions/{n:0{DIGITS}d}" for n in numbers if n not in kept]
        for name in gone:
            fs, path = self._fs(name)
            fs.delete(path, True)
        return gone
