"""Tables in the folder that driver and executors share: they cut lineage and survive
lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from citewell.errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; on a
    cluster its absence is an error, since local folders are not shared there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="citewell-"))
    return sc.getCheckpointDir()


#: Tables that this process has written and not removed.
_made: set[str] = set()


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``clean`` removes what is written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def stored(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared folder; its path."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and
    the rows survive lost executors. ``clean`` removes what is left when the results
    that read it have been stored."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by ``durable`` that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)
        _made.difference_update({p for p in _made if p.rpartition("/")[2] == folder.rpartition("/")[2]})


def made() -> frozenset[str]:
    """The tables that this process has written and not removed."""
    return frozenset(_made)


def clean(spark: SparkSession, since: frozenset[str] = frozenset(), keep: str | None = None) -> None:
    """Remove the tables that this process has written here, but for those
    of ``since`` and those named ``keep``."""
    for path in made() - since:
        if keep is None or not path.rpartition("/")[2].startswith(f"{keep}-"):
            remove(spark, path)
            _made.discard(path)
