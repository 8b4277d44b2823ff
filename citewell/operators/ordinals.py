"""Row numbers over any number of rows, without a task that sees them all.

Rows are dealt to ranges of their order and sorted there; a row's number is its place
in its range behind the rows of the ranges before. Only one row a range is summed in
order. The numbered rows are stored, since numbers made again could differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citewell.operators.durable import durable

#: The place of a row in its partition, in the lower bits of Spark's growing ids.
IN_PARTITION = (1 << 33) - 1


def within(rows: DataFrame, part: str, name: str) -> DataFrame:
    """``rows``, whose partitions stand in the order of ``part`` and have a column
    ``_in`` of places inside, with their number through all partitions, from 0."""
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # One row a partition.
    ahead = F.sum("_n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    before = sizes.select(F.col(part).alias("_of"), F.coalesce(ahead, F.lit(0)).alias("_before"))
    joined = rows.join(F.broadcast(before), F.col(part) == F.col("_of"))
    return joined.withColumn(name, (F.col("_before") + F.col("_in")).cast("bigint")).drop(part, "_in", "_n", "_of", "_before")


def numbered(rows: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """``rows`` with their number in ``order``, from 0. Rows that ``order`` does not tell
    apart are numbered in any order, which then stays as it is."""
    # However many rows tie, they can be dealt to several ranges.
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie")).drop("_tie")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION).cast("bigint"))
    dealt = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_in", place)
    return within(durable(dealt, "numbered"), "_part", name)


def by_file(rows: DataFrame, name: str = "number") -> DataFrame:
    """Rows read from files, with their number from 0 in the order of paths and of places
    in a file. Each split is read where it lies: its rows are counted, and numbered behind
    those of the splits before. The files must stay as they are until the rows are used."""
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    placed = rows.select("*", split.alias("_split"), F.monotonically_increasing_id().alias("_id"))
    # One row a split.
    sizes = placed.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    ahead = F.sum("_n").over(W.orderBy("_split").rowsBetween(W.unboundedPreceding, -1))
    before = sizes.select(F.col("_split").alias("_of"), "_first", F.coalesce(ahead, F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(before), F.col("_split") == F.col("_of"))
    number = (F.col("_before") + F.col("_id") - F.col("_first")).cast("bigint")
    return joined.withColumn(name, number).drop("_split", "_of", "_id", "_first", "_before")
