"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link when at most two bits differ. They are cut into two
segments of 32 bits: of two differing bits, one segment has at most one. So linked
fingerprints either share a segment, or share a segment with the same one bit
deleted and that bit unlike. An index holds each segment and its 32 one-wildcard
variants; an equality join finds candidates, which are then verified.

Only distinct fingerprints are joined: copies never meet. Keys are first counted by
partial aggregation; a key of two fingerprints is a candidate pair as it stands, and
only keys of three or more fetch their members. A broadcast filter of these keys drops
nearly all other entries where they are made, so the index is shuffled once, not twice;
what passes by chance meets no key in the join behind it. A bucket of the index with more than
``BUCKET`` fingerprints is not paired but cut again by the rest of the fingerprint
with its remaining bits deleted; who shares such a key is linked for certain, so a
star to the smallest member loses no link in the components (``links`` then gives
the star, not every pair).

Defined results: a null or empty text has fingerprint zero and links like any
other; repeated rows get equal results; a null doc_id never names a component
unless all of its members are null; a text of any length is hashed whole, its
shingles in blocks; an empty table gives an empty result; only doc_id and text are
read, so further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell import ship
from citewell.llm.common import discard, documents, durable, whole

SHINGLE = 3
BITS, SEGMENT = 64, 32
SEED = 42
BUCKET = 256
#: Entries of the index that a task makes.
ENTRIES = 500_000
#: Bits of the filter for each key, and its size in bits as a power of two: within these
#: bounds it grows with the keys. With more keys than it is made for, more entries pass.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 16, 12, 24
#: Shingles counted at a time: bounds memory for very long texts.
CHUNK = 1 << 16
LOW = (1 << SEGMENT) - 1


def simhash(text: str, width: int = SHINGLE) -> int:
    """The fingerprint, unsigned. ``bytes`` lower-case and split ASCII alone."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    begin, end = starts[:n].tolist(), ends[width - 1 :].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin[at : at + CHUNK], end[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py() or "") for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    ship()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _segment(s: int):
    fp = F.col("fp") if s == 0 else F.shiftrightunsigned("fp", SEGMENT)
    return fp.bitwiseAND(F.lit(LOW).cast("bigint"))


def variants(fps: DataFrame) -> DataFrame:
    """fp, key, bit: the index. A key holds segment, wildcard (32: none) and the
    segment without the wildcard's bit; ``bit`` is that bit."""
    entries = []
    for s in (0, 1):
        seg = _segment(s)
        for w in range(SEGMENT + 1):
            gone = 1 << w if w < SEGMENT else 0
            masked = seg.bitwiseAND(F.lit(LOW & ~gone).cast("bigint"))
            head = F.lit(((s << 6) | w) << SEGMENT).cast("bigint")
            bit = (seg.bitwiseAND(F.lit(gone).cast("bigint")) != 0) if gone else F.lit(None).cast("boolean")
            entries.append(F.struct(head.bitwiseOR(masked).alias("key"), bit.alias("bit")))
    return fps.select("fp", F.explode(F.array(*entries)).alias("v")).select("fp", "v.key", "v.bit")


def _bit(x):
    """A long with one bit set, that of the lowest six bits of ``x``."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def _among(index: DataFrame, keys: DataFrame, most: int = FILTER_MOST) -> DataFrame:
    """The entries whose key is one of ``keys``, and a few others, without a shuffle of
    the index: keys are hashed to bits, and its words are broadcast, 2 ** (most - 6) at most."""
    power = min(max((FILTER_BITS * keys.count()).bit_length(), FILTER_LEAST), most)
    at = F.shiftrightunsigned(F.xxhash64("key"), 64 - power)
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("set"))
    held = (F.shiftright(at, 6) == F.col("word")) & (F.col("set").bitwiseAND(_bit(at)) != 0)
    return index.join(F.broadcast(words), held, "left_semi")


def _differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _deleted(most: int):
    """From fp and a bucket's key, the keys that its linked members share: the
    bucket's segment with its wildcard deleted and the other with what is left."""
    masks = []
    for s in (0, 1):
        other = SEGMENT * (1 - s)
        if most == 1:  # a wildcard in the bucket's segment, one in the other
            masks.append([(1 << (other + j)) for j in range(SEGMENT)])
        else:  # segment shared; two in the other
            masks.append([(1 << (other + j)) | (1 << (other + k)) for j in range(SEGMENT) for k in range(j)])
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(hot: DataFrame) -> DataFrame:
    """Links inside buckets too large to pair. ``hot`` has fp, key.

    With two bits deleted from the whole fingerprint, equal keys mean at most two
    differing bits: every member is linked to the smallest.
    """
    seg = F.shiftrightunsigned("key", SEGMENT + 6).cast("int")
    wild = F.shiftrightunsigned("key", SEGMENT).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    one, two = _deleted(1), _deleted(2)
    longs = lambda xs: F.array(*(F.lit(_signed(x)).cast("bigint") for x in xs))
    pick = lambda m: F.when(seg == 0, longs(m[0])).otherwise(longs(m[1]))
    own = F.when(wild < SEGMENT, F.call_function("shiftleft", F.lit(1).cast("bigint"), wild + seg * SEGMENT)).otherwise(F.lit(0).cast("bigint"))
    masks = F.when(wild < SEGMENT, pick(one)).otherwise(pick(two))
    keyed = hot.select("fp", own.alias("own"), F.explode(masks).alias("mask")).select(
        "fp", F.col("own").bitwiseOR(F.col("mask")).alias("mask")
    )
    rest = F.col("fp").bitwiseAND(F.bitwise_not("mask"))
    keyed = keyed.select("fp", "mask", rest.alias("rest")).distinct()
    least = keyed.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(least.drop("n"), ["mask", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: pairs of distinct fingerprints at most two bits apart, all of them
    but for large buckets, whose members are linked through their smallest."""
    parts = -(-fps.count() * 2 * (SEGMENT + 1) // ENTRIES)
    index = variants(fps.repartition(max(parts, 1), "fp"))
    # Most keys have one fingerprint. Counts tell them apart, and are merged before
    # they are shuffled: a key that many share is no task's burden.
    keys = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    keys = durable(keys.where("n > 1"), "simhash-keys")
    close = _differing("a", "b") <= 2
    pairs = keys.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(close)
    many = keys.where("n > 2").select("key", (F.col("n") > bucket).alias("hot"))
    held = durable(_among(index, many).join(many, "key"), "simhash-index")
    entries = held.where("NOT hot")
    left = entries.where("bit IS NULL OR NOT bit").select("key", F.col("fp").alias("a"), F.col("bit").isNull().alias("same"))
    right = entries.where("bit IS NULL OR bit").select("key", F.col("fp").alias("b"), F.col("bit").isNull().alias("same"))
    more = left.join(right, ["key", "same"]).where((~F.col("same") | (F.col("a") < F.col("b"))) & close)
    pairs = pairs.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    hot = held.where("hot").select("fp", "key")
    if not hot.isEmpty():
        pairs = pairs.unionByName(_stars(hot))
    return pairs.distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and hash of a set of edges."""
    each = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(each), F.bit_xor(F.xxhash64(each))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: every node that has a link, with its component's smallest node.

    Alternates large-star and small-star steps until nothing changes; each step is
    written to the shared folder, the one before it removed.
    """
    now = durable(edges.select("a", "b").where("a <> b"), "components")
    for _ in range(rounds):
        before = now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = durable(large, "components-large")
        # Small-star: b is now above a; link all lower neighbours of b, and b, to the least.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
        small = small.unionByName(down.select(F.col("m").alias("a"), "b")).distinct()
        now = durable(small, "components-small")
        same = _state(now) == _state(before)
        discard(before)
        discard(large)
        if same:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id (its smallest doc_id) of every row."""
    rows = durable(fingerprints(docs), "simhash-rows")
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), bucket))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = durable(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each component: the row with its smallest doc_id (null only
    if all are null), of rows that share it the one with the smallest text hash.
    Columns as in the input.

    Rows are told apart by doc_id and text: components whose smallest doc_ids are
    equal or null keep a row each. Rows with equal texts are always one component.
    """
    key = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.col("doc_id").alias("id"),
        F.xxhash64(whole("text")).alias("hash"),
        F.length(whole("text")).alias("n"),
    )
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"))
    # Plain columns that are never null: both sides are dealt by them alike.
    flat = lambda k: (
        k["none"].alias("_none"), F.coalesce(k["id"].cast("string"), F.lit("")).alias("_id"), k["hash"].alias("_hash"), k["n"].alias("_n")
    )
    names = ["_none", "_id", "_hash", "_n"]
    ids = found.select("component_id").distinct().select(*flat(F.col("component_id")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # away from the names used here
    # Whole rows are shuffled once: repeated rows are merged before, and the merge
    # join takes them as they lie. (A join turned into a broadcast would not.)
    rows = docs.select(row, key.alias("_doc")).select("_row", *flat(F.col("_doc"))).dropDuplicates(names)
    return rows.join(ids.hint("merge"), names, "left_semi").select("_row.*")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")
