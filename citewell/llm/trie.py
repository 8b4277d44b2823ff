"""A prefix trie of conversations, built level by level.

Conversations that are equal turn for turn are merged first and go on as one, with a
weight. Then, depth by depth, the live ones are grouped by (parent node, next turn);
a group is a node, named by its smallest conv_id. One that holds a single sequence is
the head of a chain: all that is below it is read off its turns at once. So the levels end
where the last two different sequences part, however long they go on. Then, level by
level from the deepest, children are joined to their parents, which sum up leaves and
savings.

Turns are told apart by SHA-256 of role and text (128 bits of it), so texts stay in the
scan. Their places come from a distributed numbering, not from a sort inside a conversation.
Groups are made by partial aggregation; live conversations get their node by a join that
stands on its exchanges, where hot groups are split. Live rows carry at most ``STRIDE``
turns ahead.

Defined results: a null role or text is empty; turns are ordered by number, null first,
of equal numbers by the hash of role and text; rows equal in all are turns of their own;
rows without conv_id belong to no conversation and are left out; a conversation may have
no turn and is then a member of the root alone; an empty table has no nodes; texts of any
length are hashed whole; only conv_id, turn, role and text are read, so further columns
may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citewell import ship
from citewell.operators.durable import durable, stored
from citewell.operators.ordinals import numbered

#: Turns that a live conversation carries ahead.
STRIDE = 16
#: Consecutive conv_ids that are joined before their list is hashed.
IDS = 256
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
NO_ENDS = hashlib.sha256(b"").hexdigest()
SEQUENCE = ("n", "x1", "x2")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), key (of role and text) and bytes (of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marked = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.substring(F.unhex(F.sha2(marked, 256)), 1, 16).alias("key"), F.octet_length(text).cast("bigint").alias("bytes")
    )
    rows = numbered(rows, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"))
    first = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("number").alias("_first"))
    joined = rows.join(first, F.col("conv_id") == F.col("_conv"))
    return joined.select("conv_id", (F.col("number") - F.col("_first") + 1).alias("place"), "key", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and turns (conv_id, place, key, bytes) where each c begins
    with the first h turns of c - c % group and goes on with its own after the first h;
    h is crc32(c) % (most + 1)."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    sized = convs.select(F.col("conv_id").alias("_id"), F.col("n").alias("_n"))
    convs = convs.select("conv_id", base.alias("base"), h.alias("h")).join(sized, F.col("base") == F.col("_id"), "left")
    taken = F.least("h", F.coalesce("_n", F.lit(0)))
    convs = durable(convs.select(F.col("conv_id").alias("c"), "base", "h", taken.alias("taken")), "trie-convs")
    own = turns.join(convs, F.col("conv_id") == F.col("c")).where(F.col("place") > F.col("h"))
    own = own.select("c", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "key", "bytes")
    lead = turns.where(F.col("place") <= most).join(convs, F.col("conv_id") == F.col("base")).where(F.col("place") <= F.col("h"))
    every = own.unionByName(lead.select("c", "place", "key", "bytes"))
    return convs.select(F.col("c").alias("conv_id")), every.withColumnRenamed("c", "conv_id")


def _sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id with n and two hashes of its whole sequence of turns."""
    each = [F.bit_xor(F.xxhash64(F.lit(salt), "place", "key")).alias(f"x{salt}") for salt in (1, 2)]
    sums = turns.groupBy(F.col("conv_id").alias("_conv")).agg(F.count(F.lit(1)).alias("n"), *each)
    joined = convs.join(sums, F.col("conv_id") == F.col("_conv"), "left")
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in SEQUENCE))


def _digests(sequences: DataFrame) -> DataFrame:
    """The sequence and the hash of the list of all conv_ids that have it.

    Ids are joined in pieces of at most ``IDS`` first; a task then streams the pieces of
    its sequences through the hash and holds none of them."""
    pieces = sequences.groupBy(*SEQUENCE, F.floor(F.col("conv_id") / IDS).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        names = [*SEQUENCE, "ends_sha256"]
        row = lambda: [*now, digest.hexdigest()]
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*SEQUENCE, "ids")), strict=True):
                if key != now:
                    if now is not None:
                        out.append(row())
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)))
        if now is not None:
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(names, row(), strict=True)})

    ship()
    dealt = pieces.repartition(*SEQUENCE).sortWithinPartitions(*SEQUENCE, "piece").select(*SEQUENCE, "ids")
    return dealt.mapInArrow(run, "n bigint, x1 bigint, x2 bigint, ends_sha256 string")


def _ahead(turns: DataFrame, block: int) -> DataFrame:
    """_conv and its turns of one block, as an array in order."""
    some = turns.where((F.col("place") > block * STRIDE) & (F.col("place") <= (block + 1) * STRIDE))
    return some.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.sort_array(F.collect_list(F.struct("place", "key", "bytes"))).alias("turns")
    )


def _levels(live: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The nodes of each depth (node, parent, n_convs, bytes, n_sequences, n: of a single
    sequence) and the live sequences that end at a node of that depth (conv, node)."""
    root = live.agg(
        F.min("conv").alias("node"), F.lit(None).cast("bigint").alias("parent"), F.sum("weight").alias("n_convs"),
        F.lit(0).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("n_sequences"), F.max("n").alias("n"),
    ).where("node IS NOT NULL")
    nodes, ends, depth = [durable(root, "trie-nodes")], [], 0
    top = nodes[0].first()  # one row at most
    now = live.withColumn("node", F.lit(top.node if top else None).cast("bigint"))
    while not nodes[-1].where("n_sequences > 1").isEmpty():
        if depth % STRIDE == 0:
            now = now.drop("turns").join(_ahead(turns, depth // STRIDE), F.col("conv") == F.col("_conv"), "left")
        now = durable(now.select("conv", "n", "weight", "node", "turns"), "trie-live")
        ends.append(now.where(F.col("n") == depth).select("conv", "node"))
        turn = F.get("turns", F.lit(depth % STRIDE))
        going = now.where(F.col("n") > depth).withColumn("key", turn["key"]).withColumn("size", turn["bytes"])
        made = going.groupBy("node", "key").agg(
            F.min("conv").alias("child"), F.sum("weight").alias("n_convs"), F.max("size").alias("bytes"),
            F.count(F.lit(1)).alias("n_sequences"), F.max("n").alias("n"),
        )
        made = durable(made, "trie-nodes")
        nodes.append(made.select(F.col("child").alias("node"), F.col("node").alias("parent"), "n_convs", "bytes", "n_sequences", "n"))
        on = made.where("n_sequences > 1").select(F.col("node").alias("_node"), F.col("key").alias("_key"), "child")
        now = going.join(on, (F.col("node") == F.col("_node")) & (F.col("key") == F.col("_key")))
        now = now.select("conv", "n", "weight", F.col("child").alias("node"), "turns")
        depth += 1
    return nodes, ends


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie over ``convs`` (conv_id) and their ``turns`` (conv_id, place
    from 1, key, bytes): the columns of ``NODE`` and ends_sha256."""
    spark = convs.sparkSession
    turns = durable(turns, "trie-turns")
    sequences = durable(_sequences(convs, turns), "trie-sequences")
    live = sequences.groupBy(*SEQUENCE).agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("weight"))
    live = durable(live.join(_digests(sequences), list(SEQUENCE)), "trie-classes")
    digest = live.select(F.col("conv").alias("_ended"), "ends_sha256")
    live = live.select("conv", "n", "weight")
    nodes, ends = _levels(live, turns)

    # Chains: from its head on, a single sequence has a node for every turn.
    heads = None
    for depth, level in enumerate(nodes):
        some = level.where("n_sequences = 1").select(F.col("node").alias("conv"), "parent", F.col("n_convs").alias("weight"), "n", F.lit(depth).cast("bigint").alias("head"))
        heads = some if heads is None else heads.unionByName(some)
    heads = durable(heads, "trie-heads")
    own = turns.join(heads, F.col("conv_id") == F.col("conv")).where(F.col("place") >= F.col("head"))
    size = F.col("bytes") * (F.col("weight") - 1)
    repeated = own.where("weight > 1").withColumn("size", size)
    below = W.partitionBy("conv").orderBy(F.col("place").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    links = repeated.withColumn("saved", F.sum("size").over(below)).unionByName(own.where("weight = 1").withColumn("size", size).withColumn("saved", F.lit(0).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    chain = links.select(
        "conv_id", F.col("place").alias("depth"), F.when(F.col("place") == F.col("head"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"), (F.col("place") < F.col("n")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.when(F.col("place") == F.col("n"), F.col("conv")).alias("_end"),
    )
    total = durable(repeated.groupBy(F.col("conv").alias("_head")).agg(F.sum("size").alias("chain")), "trie-chains")

    # From the deepest level up: children give their parents leaves and savings.
    paths, children, ended = [], None, None
    for depth in range(len(nodes) - 1, -1, -1):
        level = nodes[depth]
        head = level.where("n_sequences = 1").join(total, F.col("node") == F.col("_head"), "left")
        done = head.select("node", "parent", "n_convs", F.lit(1).cast("bigint").alias("n_leaves"), F.coalesce("chain", zero).alias("saved"), F.lit(False).alias("inner"), zero.alias("n_children"))
        if children is not None:
            inner = level.where("n_sequences > 1").join(children, F.col("node") == F.col("_of"))
            saved = F.col("below") + (F.col("n_convs") - 1) * F.col("bytes")
            done = done.unionByName(inner.select("node", "parent", "n_convs", "n_leaves", saved.alias("saved"), F.lit(True).alias("inner"), "n_children"))
        done = done.withColumn("depth", F.lit(depth).cast("bigint"))
        schema = done.schema
        paths.append(stored(done, "trie-done"))
        children = spark.read.schema(schema).parquet(paths[-1]).groupBy(F.col("parent").alias("_of")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below")
        )
    for depth, some in enumerate(ends):
        some = some.select(F.col("conv").alias("_end"), F.col("node").alias("_node"), F.lit(depth).cast("bigint").alias("_depth"))
        ended = some if ended is None else ended.unionByName(some)
    inner = spark.read.schema(schema).parquet(*paths).where("inner")
    if ended is not None:
        inner = inner.join(ended, (F.col("node") == F.col("_node")) & (F.col("depth") == F.col("_depth")), "left")
    else:
        inner = inner.withColumn("_end", F.lit(None).cast("bigint"))
    inner = inner.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "_end",
    )
    # A root that is itself the head of a chain has no turn of its own.
    top = heads.where("head = 0").join(total, F.col("conv") == F.col("_head"), "left").select(
        F.col("conv").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        (F.col("n") > 0).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.coalesce("chain", zero).alias("saved_tokens"),
        F.when(F.col("n") == 0, F.col("conv")).alias("_end"),
    )
    every = inner.unionByName(chain).unionByName(top).join(digest, F.col("_end") == F.col("_ended"), "left")
    return every.select(*NODE, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # ids are numbers, whatever integer type they have
    turns = durable(ordered_turns(conversations.withColumn("conv_id", F.col("conv_id").cast("bigint"))), "trie-ordered")
    return prefix_trie(*rebuilt(turns))



ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, k, octet_length(encode(text))::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS place FROM t
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, conv_id::VARCHAR AS s FROM o
), h AS (
  SELECT conv_id, base, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda i: ascii(substring(s, i, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
    ), 4294967295) % 9 AS h FROM c
), r AS (
  SELECT h.conv_id, place, k, size FROM h JOIN o ON o.conv_id = h.base WHERE place <= h
  UNION ALL
  SELECT h.conv_id, place + 1000000, k, size FROM h JOIN o ON o.conv_id = h.conv_id WHERE place > h
), p AS (
  SELECT conv_id, size, row_number() OVER w AS depth, string_agg(k, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), n AS (
  SELECT conv_id, depth, path, size FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c
), last AS (
  SELECT conv_id, max(depth) AS depth FROM n GROUP BY conv_id
), node AS (
  SELECT path, any_value(n.depth)::BIGINT AS depth, min(n.conv_id) AS conv_id, count(*) AS n_convs, any_value(n.size) AS size,
    string_agg(n.conv_id::VARCHAR, ',' ORDER BY n.conv_id) FILTER (WHERE n.depth = last.depth) AS ends
  FROM n JOIN last USING (conv_id) GROUP BY path
), kids AS (
  SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1
), up AS (
  SELECT left(a.path, (64 * d)::INT) AS path, sum((a.n_convs - 1) * a.size) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM node a LEFT JOIN kids ON kids.path = a.path, range(0, 1000) AS g(d) WHERE d <= a.depth GROUP BY 1
)
SELECT node.conv_id, node.depth, up_node.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN up ON up.path = node.path LEFT JOIN kids ON kids.path = node.path
LEFT JOIN node AS up_node ON node.depth > 0 AND up_node.path = left(node.path, length(node.path) - 64)
"""
