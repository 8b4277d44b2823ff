"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation once per turn, each a prefix of the next. Every turn
gets a rolling hash of the turns up to it; a conversation whose last hash is that
of a turn inside a longer one is a snapshot of it. An anti-join drops snapshots,
equal conversations are kept once, and what is left is rendered.

The rolling hash is a running XOR of two 64-bit hashes of (place, role, text), so
a window computes it row by row without holding a conversation.

Defined results: turns are ordered by number (nulls last), then role and text;
rows of a conversation equal in all three count once; a null role is ``unknown``,
a null text empty; nothing ties rows without conv_id together, so each is a
conversation of one turn; of equal conversations the smallest conv_id stays, null if
none has one; a conversation is rendered whole, whatever its texts' length; an empty
table gives an empty result; only conv_id, turn, role and text are read, so further
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citewell.llm.common import durable

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
UNKNOWN = "unknown"


def role_and_text() -> tuple[Column, Column]:
    return F.coalesce("role", F.lit(UNKNOWN)), F.coalesce("text", F.lit(""))


def _hashes(place: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), place, "role", "sha") for salt in (1, 2)]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), h1 and h2 (hashes of the turns up to it), last."""
    role, text = role_and_text()
    every = turns.select("conv_id", "turn", role.alias("role"), F.sha2(text, 256).alias("sha"))
    rows = every.where("conv_id IS NOT NULL")
    conv = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "sha")
    this = F.struct("turn", "role", "sha")
    rows = rows.withColumn("again", this.eqNullSafe(F.lag(this).over(conv))).where("NOT again").drop("again")
    rows = rows.withColumn("place", F.row_number().over(conv))
    rows = rows.withColumn("last", F.lead("place").over(conv).isNull())
    upto = conv.rowsBetween(W.unboundedPreceding, W.currentRow)
    h1, h2 = (F.bit_xor(h).over(upto) for h in _hashes(F.col("place")))
    rolled = rows.select("conv_id", "place", h1.alias("h1"), h2.alias("h2"), "last")
    h1, h2 = _hashes(F.lit(1))
    loose = every.where("conv_id IS NULL").select("conv_id", F.lit(1).alias("place"), h1.alias("h1"), h2.alias("h2"), F.lit(True).alias("last"))
    return rolled.unionByName(loose)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal (conversations equal to it), h1 and h2 of those to keep."""
    rolled = durable(prefixes(turns), "chat-prefixes")
    whole = rolled.where("last").groupBy("place", "h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal")
    )
    inside = rolled.where("NOT last").select("place", "h1", "h2").distinct()
    kept = whole.join(inside, ["place", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("place").cast("bigint").alias("n_turns"), "n_equal", "h1", "h2")


def rendered(turns: Column) -> Column:
    """Turns as one string. The marks are spaced out where a text holds them."""
    safe = lambda x: F.replace(x, F.lit("<|"), F.lit("< |"))
    one = lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(f"{CLOSE}\n"))
    return F.array_join(F.transform(turns, one), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal and rendered text of the maximal conversations."""
    kept = durable(maximal(turns), "chat-kept").withColumnRenamed("conv_id", "_conv")
    role, text = role_and_text()
    turn = F.struct(
        F.col("turn").isNull().alias("late"), "turn", role.alias("role"), F.sha2(text, 256).alias("sha"), text.alias("text")
    )
    rows = turns.select("conv_id", turn.alias("t"))
    rows = rows.join(kept.select("_conv"), F.col("conv_id") == F.col("_conv"), "left_semi")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    out = ("conv_id", "n_turns", "n_equal", rendered(F.col("turns")).alias("rendered"))
    named = whole.join(kept, F.col("conv_id") == F.col("_conv")).select(*out)
    # Rows without conv_id: equal ones are merged before they are shuffled.
    h1, h2 = _hashes(F.lit(1))
    loose = turns.where("conv_id IS NULL").select("conv_id", role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    loose = loose.select("conv_id", "role", "text", h1.alias("h1"), h2.alias("h2")).dropDuplicates(["h1", "h2"])
    loose = loose.withColumn("turns", F.array(F.struct("role", "text"))).join(kept.where("_conv IS NULL"), ["h1", "h2"])
    return named.unionByName(loose.select(*out))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH n AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, 'row ' || row_number() OVER ()) AS conv, turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), t AS (
  SELECT DISTINCT conv, conv_id, turn, role, text FROM n
), p AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv) AS n,
         list(struct_pack(role := role, text := text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turns
  FROM t WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS LAST, role, sha256(text))
), whole AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM p WHERE place = n GROUP BY turns
)
SELECT conv_id, len(turns)::BIGINT AS n_turns, n_equal::BIGINT AS n_equal,
  array_to_string(list_transform(turns, lambda x: '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10)
    || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS rendered
FROM whole WHERE turns NOT IN (SELECT turns FROM p WHERE place < n)
"""
