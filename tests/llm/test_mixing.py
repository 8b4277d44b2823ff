import random

import pytest
from pyspark.sql import functions as F

from citewell.llm import mixing
from citewell.llm.common import durable


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.fixture
def many(docs):
    rng = random.Random(9)
    rows = []
    for k in range(800):
        source = rng.choice(["a", "b", "b", "b", "ü", "Z", None, "tiny"] if k < 790 else ["tiny"])
        rows.append((k, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40]))), "en", source))
    return rows


def test_targets_and_exact_cuts(docs, many):
    mixed = mixing.mix(durable(mixing.sizes(docs(many)), "t")).collect()
    sizes = {}
    for _, t, _, s in many:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    wanted = plain_targets(sizes)
    assert len(mixed) == len(many)
    taken = {}
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert taken == {s: round(t) for s, t in wanted.items()}
    again = mixing.mix(durable(mixing.sizes(docs(many).repartition(5)), "t")).collect()
    key = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert key(again) == key(mixed)


def test_documents_hold_what_the_plan_says(docs, many):
    df = docs(many).withColumn("size", F.lit("mine")).withColumn("target", F.lit(0))
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    plan = mixing.mix(durable(mixing.sizes(docs(many)), "t"))
    assert {k: n for k, n in got.items() if n} == {r.doc_id: r.taken for r in plan.collect() if r.taken}


def test_repeated_rows_share_the_cut(docs):
    rows = [(1, "a b c d e", "en", "x")] * 7 + [(2, "q " * 10, "en", "y")]
    mixed = mixing.mix(durable(mixing.sizes(docs(rows)), "t")).collect()
    out = mixing.mix_documents(docs(rows))
    for s in "xy":
        words = out.where(F.col("source") == s).agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
        assert words == sum(r.taken for r in mixed if r.source == s) == round(next(r.target for r in mixed if r.source == s))


def test_rows_at_the_cut_go_in_order_of_their_other_columns(docs):
    """The same in any partitioning: rows that share the key but not all columns."""
    rows = [(1, "a b c d e", lang, "x") for lang in "zyxwv" * 3] + [(2, "q " * 30, "en", "y")]
    key = lambda df: sorted((r.doc_id, r.lang, r.text, r.n_chars) for r in df.collect())
    first = key(mixing.mix_documents(docs(rows)))
    for n in (1, 4):
        assert key(mixing.mix_documents(docs(rows[::-1]).repartition(n))) == first
    mixed = mixing.mix(durable(mixing.sizes(docs(rows)), "t")).collect()
    assert sum(len(t.split()) for i, _, t, _ in first if i == 1) == sum(r.taken for r in mixed if r.doc_id == 1)


def test_very_long_texts(docs):
    rows = [(1, "w " * 200000, "en", "x"), (2, "v" * 1000000 + " u", "en", "x"), (3, "t " * 70000, "en", "y")]
    mixed = {r.doc_id: r for r in mixing.mix(durable(mixing.sizes(docs(rows)), "t")).collect()}
    assert [mixed[k].size for k in (1, 2, 3)] == [200000, 2, 70000]
    out = mixing.mix_documents(docs(rows)).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"))
    assert {r.source: r.n for r in out.collect()} == {s: sum(r.taken for r in mixed.values() if r.source == s) for s in "xy"}


def test_odd_rows(odd):
    assert mixing.mix(durable(mixing.sizes(odd), "t")).count() == odd.count()
    assert mixing.mix(durable(mixing.sizes(odd.limit(0)), "t")).isEmpty()
    assert mixing.mix_documents(odd.limit(0)).isEmpty()
    assert mixing.mix_documents(odd).columns == odd.columns


def test_only_empty_texts(docs):
    mixed = mixing.mix(durable(mixing.sizes(docs([(1, ""), (2, None)])), "t")).collect()
    assert [(r.target, r.taken) for r in mixed] == [(0.0, 0), (0.0, 0)]
