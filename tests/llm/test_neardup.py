import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from citewell.llm import neardup


def plain_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    f = np.array(fps, dtype=np.uint64)
    for k in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(f ^ f[k]) <= 2)[0]:
            root[find(k)] = find(int(j))
    return [find(k) for k in range(len(fps))]


def same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("text", ["", " \n", "One", "a b", "A b C", "İ x y", "a b c d e f g " * 50, "é\xa0é b c"])
def test_fingerprint(text):
    assert neardup.simhash(text) == plain_simhash(text)


@pytest.mark.parametrize("bucket", [2, 5, 256])
def test_components_of_close_fingerprints(spark, bucket):
    """Small buckets force the way for large ones; the parts must be the same."""
    rng = random.Random(bucket)
    fps = {0, 1, 3, (1 << 64) - 1}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    found = {r.node: r.root for r in neardup.components(neardup.links(df, bucket)).collect()}
    assert same_parts([found.get(x, x) for x in signed], plain_components(fps))


def test_the_index_is_shuffled_once(spark, monkeypatch):
    """Also where the keys that fetch their members are too many for a broadcast join."""
    monkeypatch.setattr(neardup, "ENTRIES", 50_000)
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(4000)]
    fps = sorted({x ^ 1 << k for x in fps[:40] for k in range(5)} | set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")

    def shuffled(made):
        sc = spark.sparkContext._jsc.sc()
        before = sc.statusStore().executorList(False).apply(0).totalShuffleWrite()
        rows = made().collect()
        sc.listenerBus().waitUntilEmpty(30_000)
        return rows, sc.statusStore().executorList(False).apply(0).totalShuffleWrite() - before

    once = shuffled(lambda: neardup.variants(df).groupBy("key").agg(F.count("fp").alias("n"), F.min("fp"), F.max("fp")).where("n > 1"))[1]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, written = shuffled(lambda: neardup.links(df))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert 0 < once and written < 1.5 * once
    near = {(a, b) for a in signed for b in signed if a < b and (a ^ b).bit_count() <= 2}
    assert {(r.a, r.b) for r in pairs} == near


@pytest.mark.parametrize("most", [6, 12, 24])
def test_the_filter_loses_no_entry(spark, most):
    """Full or sparse, it passes every entry with a key; sparse, it drops most others."""
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    index = neardup.variants(fps)
    keys = index.where("pmod(hash(key), 100) = 0").select("key").distinct()
    passed = neardup._among(index, keys, most)
    wanted = index.join(keys, "key")
    assert passed.join(keys, "key").count() == wanted.count() > 1000
    assert neardup._among(index, keys.limit(0), most).isEmpty()
    if most == 24:
        assert passed.count() < wanted.count() + 0.1 * index.count()


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a bigint, b bigint")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert all(got.get(k, 0) == 0 for k in range(1, 201)) and got[501] == 500


def test_documents(docs, odd, spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(9, text), (3, text), (5, text.replace("w399", "other")), (7, "quite another text with its own words")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(rows)).collect()}
    parts = plain_components([plain_simhash(t) for _, t in rows])
    ids = [i for i, _ in rows]
    assert got == {i: min(j for j, p in zip(ids, parts, strict=True) if p == parts[k]) for k, i in enumerate(ids)}
    kept = neardup.keep_representatives(docs(rows).withColumn("fp", F.lit("mine")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and "fp" in kept.columns
    found = neardup.near_duplicates(odd)
    assert found.count() == odd.count()
    by = {r.doc_id: r for r in found.collect()}
    assert by[1].fp == by[2].fp == 0 and by[2].component_id == 1
    assert by[5].fp % (1 << 64) == plain_simhash("\x00 \t\n") and by[5].component_id == 5
    assert by[4].component_id == by[7].component_id == 4
    assert neardup.near_duplicates(odd.limit(0)).isEmpty() and neardup.keep_representatives(odd.limit(0)).isEmpty()


def test_a_large_group_of_copies_is_one_class(docs):
    rows = [(k, "the same text for all of these rows") for k in range(3000)] + [(5000, "and one that is not like it at all")]
    got = neardup.near_duplicates(docs(rows))
    assert got.where("component_id = 0").count() == 3000 and got.where("component_id = 5000").count() == 1


def test_representatives_with_null_and_repeated_ids(docs, odd):
    """Rows that share a doc_id, or have none, stay unless they are near duplicates."""
    text = lambda x: " ".join(f"{x}{k}" for k in range(50))
    rows = [(None, text(x)) for x in "abcde"] + [(None, text("a")), (3, text("p")), (5, text("p")), (5, text("q"))]
    rows += [(None, text("r")), (8, text("r")), (9, text("s")), (9, text("s"))]
    kept = sorted(((r.doc_id or 0, r.text) for r in neardup.keep_representatives(docs(rows)).collect()))
    assert kept == sorted([(0, text(x)) for x in "abcde"] + [(3, text("p")), (5, text("q")), (8, text("r")), (9, text("s"))])
    kept = [(r.doc_id, r.text) for r in neardup.keep_representatives(odd).collect()]
    fps = {plain_simhash(t or "") for t in (r.text for r in odd.collect())}
    assert len(kept) == len(set(plain_components(sorted(fps)))) == len({plain_simhash(t or "") for _, t in kept})
    assert (None, "no id") in kept and (1, None) in kept
