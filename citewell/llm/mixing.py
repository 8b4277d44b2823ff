"""Mixing sources to target weights, exactly to the word.

Each row gets a hash-random key. Within a source the rows are range-partitioned
by key into ranges of nearly equal size (the keys are uniform, so equal-width
ranges are), prefix sums run inside each range, and the sums of the ranges before
it are added: no task ever sees a whole source. A source's budget is cut exactly
where its prefix sum reaches it; budgets beyond the source's size repeat it in
whole epochs first.

What orders sources (their weights, caps and targets) is a table of one row a source,
sorted in one task: tens of millions of sources fit there, and its size is that of the
sources, never of the rows.

Defined results: a null text has size 0; a null source is a source of its own,
after all others; rows that are equal in doc_id and text share a key, and those that
differ in other columns are then taken in the order of these; an empty table gives an
empty mix; a source of only empty texts has target 0; a text of any length is counted
whole, and cut by one pass over it. The row where the cut falls gives only its first
words. Only doc_id, text and source are read; further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citewell.llm.common import WORD, documents, durable, whole

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Hex digits of a key that place it in a range.
KEY_DIGITS = 8


def key_of(doc_id: Column, text: Column) -> Column:
    """Uniform, and the same in every run."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), whole(text)))


def sizes(docs: DataFrame, source: str = "source") -> DataFrame:
    """row_id, doc_id, source, size and key of every row; texts stay behind."""
    text = whole("text")
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        F.col(source).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        key_of(F.col("doc_id"), F.col("text")).alias("key"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, n_rows, source_size, target.

    The fixed point of resharing: sources in order of cap over weight, capped as
    long as their cap is at most their share of what the ones before leave.
    """
    by = sized.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").cast("bigint").alias("source_size")
    )
    # One row per source from here on; these windows order sources, not rows: see above.
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank"), F.lit(len(weights))) + 1)
    s = by.withColumn("rank", rank).withColumn("w", weight.cast("bigint"))
    s = s.withColumn("cap", F.lit(epochs) * F.col("source_size"))
    upto = W.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every)).alias("whole"),
        F.coalesce(F.sum("cap").over(upto), F.lit(0)).alias("caps"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0))).alias("rest"),
    )
    left = F.col("whole") - F.col("caps").cast("double")
    s = s.withColumn("left", left).withColumn(
        "capped", F.col("cap").cast("double") * F.col("rest") <= F.col("left") * F.col("w")
    )
    # The first uncapped source has what is left for it and all after it.
    first = F.min(F.when(~F.col("capped"), F.struct("caps", "left", "rest"))).over(every)
    return s.withColumn("first", first).select(
        "source",
        "n_rows",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise(F.col("first.left") * F.col("w") / F.col("first.rest"))
        .alias("target"),
    )


def mix(sized: DataFrame, **how) -> DataFrame:
    """``sized`` with source_size, target, epochs (whole ones), cut (words of the
    last, partial epoch of the source), before (words ahead of the row in an
    epoch), last (words the row gives to the partial epoch) and taken."""
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    size = F.col("source_size")
    # The rows that a range holds grow with the root of the input, as do the ranges.
    held = F.greatest(F.lit(256), 2 * F.sqrt(F.sum("n_rows").over(every)))
    epochs = F.when(size > 0, F.floor(F.round("target") / size)).otherwise(0).cast("bigint")
    per = targets(sized, **how).select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        epochs.alias("epochs"),
        (F.round("target").cast("bigint") - epochs * size).alias("cut"),
        F.greatest(F.lit(1), F.ceil(F.col("n_rows") / held)).cast("bigint").alias("ranges"),
    )
    place = F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("bigint")
    rows = sized.join(per, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "range", F.floor(place * F.col("ranges") / F.lit(float(16**KEY_DIGITS))).cast("bigint")
    )
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = (
        rows.groupBy("source", "range")
        .agg(F.sum("size").alias("sum"))
        .select(
            F.col("source").alias("_s"),
            F.col("range").alias("_r"),
            F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"),
        )
    )
    inside = W.partitionBy("source", "range").orderBy("key", "row_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    rows = rows.withColumn("before", F.col("base") + F.col("inner")).withColumn(
        "last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - F.col("before"))).cast("bigint")
    )
    return rows.select(
        "row_id", "doc_id", "source", "size", "key", "source_size", "target", "epochs", "cut", "before", "last",
        (F.col("epochs") * F.col("size") + F.col("last")).cast("bigint").alias("taken"),
    )


def cuts(mixed: DataFrame) -> DataFrame:
    """source, epochs, cut_key, cut_before, cut: rows whose key is under cut_key
    are in the partial epoch as a whole; the cut falls among those that have it."""
    reaches = F.col("before") + F.col("size") > F.col("cut")
    found = mixed.groupBy(F.col("source").alias("_source"), "epochs", "cut").agg(F.min(F.when(reaches, F.col("key"))).alias("cut_key"))
    found = durable(found, "mix-cut-keys")
    # Rows that share the key stand together; the first of them tells what is before all.
    keys = found.select(F.col("_source").alias("_s"), "cut_key")
    at = mixed.join(keys, F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("cut_key")))
    at = at.groupBy(F.col("source").alias("_at")).agg(F.min("before").alias("cut_before"))
    return found.join(at, F.col("_source").eqNullSafe(F.col("_at")), "left").drop("_at")


def first_words(text: Column, n: Column) -> Column:
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+"))
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents with the input's columns: a row for each whole epoch,
    one more for the partial epoch, shortened where the source's budget ends.

    Texts are not shuffled: a row's place follows from its key and its source's cut.
    """
    per = durable(cuts(mix(durable(sizes(docs), "mix-sizes"), **how)), "mix-cuts")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # away from the names used here
    keyed = docs.select(row, F.col("source").alias("_from"), F.col("text").alias("_text"), key_of(F.col("doc_id"), F.col("text")).alias("_key"))
    keyed = keyed.join(per, F.col("_from").eqNullSafe(F.col("_source")))
    times = F.col("epochs").cast("int") + F.when(F.col("_key") < F.col("cut_key"), 1).otherwise(0)
    rows = keyed.withColumn("_time", F.explode(F.array_repeat(F.lit(0), times))).select("_row.*")
    # Rows that share the cut's key are equal in doc_id and text; the cut falls in one of
    # them. Rows equal in all columns are merged to a count before any are ordered.
    at = keyed.where(F.col("_key") == F.col("cut_key")).groupBy("_from", "_key", F.to_json("_row").alias("_json"))
    at = at.agg(F.first("_row").alias("_row"), F.first("_text").alias("_text"), F.first(F.col("cut") - F.col("cut_before")).alias("_left"), F.count(F.lit(1)).alias("_m"))
    ahead = F.coalesce(F.sum("_m").over(W.partitionBy("_from", "_key").orderBy("_json").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    size = F.regexp_count(whole("_text"), F.lit(WORD)).cast("bigint")
    at = at.withColumn("_size", size).withColumn("_left", F.col("_left") - ahead * F.col("_size")).where(F.col("_left") > 0)
    full = F.least(F.col("_m"), F.floor(F.col("_left") / F.col("_size"))).cast("int")
    rest = F.when(F.col("_full") < F.col("_m"), F.col("_left") - F.col("_full") * F.col("_size")).otherwise(0)
    at = at.withColumn("_full", full).withColumn("_rest", rest)
    given = F.concat(F.array_repeat("_size", F.col("_full")), F.when(F.col("_rest") > 0, F.array("_rest")).otherwise(F.array().cast("array<bigint>")))
    at = at.withColumn("_last", F.explode(given))
    text = F.when(F.col("_last") >= F.col("_size"), F.col("_text")).otherwise(first_words(F.col("_text"), F.col("_last")))
    at = at.withColumn("_cut", text)
    given = {"text": F.col("_cut")}
    if "n_chars" in docs.columns:
        given["n_chars"] = F.length("_cut").cast(docs.schema["n_chars"].dataType)
    return rows.unionByName(at.select(*(given.get(c, F.col("_row")[c]).alias(c) for c in docs.columns)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(durable(sizes(documents(spark, sf_dir)), "op4-sizes"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s
), w AS (
  SELECT *, 2 * source_size AS cap, [3, 1, 2][1 + rank % 3]::BIGINT AS w FROM k
), c AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
            - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rem,
         (SELECT sum(w) FROM w)
            - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM w
), t AS (
  SELECT source, source_size,
    CASE WHEN cap::DOUBLE * rest::DOUBLE <= rem * w THEN cap::DOUBLE
         ELSE (SELECT min_by(rem, cap::DOUBLE / w) FROM c WHERE cap::DOUBLE * rest::DOUBLE > rem * w) * w
              / (SELECT min_by(rest, cap::DOUBLE / w) FROM c WHERE cap::DOUBLE * rest::DOUBLE > rem * w)::DOUBLE END AS target
  FROM c
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0
        ELSE (budget // source_size) * size
             + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END)::BIGINT AS taken
FROM r
"""
