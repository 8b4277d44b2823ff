import numpy as np
import pytest
from pyspark.sql import functions as F

from citewell.config import Settings
from citewell.errors import CorpusEmptyError
from citewell.operators import retrieve
from citewell.operators.encode import encode

VEC = "array<double>"


def corpus(spark, rows):
    return spark.createDataFrame(rows, f"chunk_id string, scheme_id string, embedding {VEC}")


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{k:03}", "ab"[k % 2], rng.normal(size=8).tolist()) for k in range(120)]
    rows += [(f"d{k}", "a", rows[0][2]) for k in range(5)]  # ties
    asked = [(k, [None, "a", "zz"][k % 3], rng.normal(size=8).tolist()) for k in range(6)]
    questions = spark.createDataFrame(asked, f"query_id int, scheme_id string, embedding {VEC}")
    found = retrieve.nearest(corpus(spark, rows).repartition(3), questions, 7, filter_by="scheme_id", least=-1.0)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q, scheme, v in asked:
        sims = [(-float(np.dot(v, e)), c) for c, s, e in rows if scheme in (None, s) and np.dot(v, e) >= -1.0]
        assert got.get(q, []) == [c for _, c in sorted((round(s, 12), c) for s, c in sims)[:7]]


@pytest.mark.parametrize("block, tile", [(1 << 25, 1 << 24), (1200, 1 << 24), (1200, 64)])
def test_nearest_in_blocks_and_tiles(spark, monkeypatch, block, tile):
    """Many questions: several blocks, each multiplied in tiles, give what one loop does."""
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", block)
    monkeypatch.setattr(retrieve, "TILE_BYTES", tile)
    rng = np.random.default_rng(8)
    rows = [(f"c{k:03}", ["a", "b", None][k % 3], rng.integers(-2, 3, size=4).astype(float).tolist()) for k in range(90)]  # many ties
    asked = [(f"c{k:03}", [None, "a"][k % 2], rows[k][2]) for k in range(90)]
    questions = spark.createDataFrame(asked, f"query_id string, scheme_id string, embedding {VEC}")
    found = retrieve.nearest(corpus(spark, rows).repartition(3), questions, 5, filter_by="scheme_id", exclude_self=True)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q, scheme, v in asked:
        sims = sorted((-float(np.dot(v, e)), c) for c, s, e in rows if scheme in (None, s) and c != q)
        assert got[q] == [c for _, c in sims[:5]]


def test_blocks_are_not_kept_on_the_driver(spark, monkeypatch):
    """Of several blocks each result is stored: the plan has no search left in it."""
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 64)
    rows = corpus(spark, [(f"c{k}", "s", [float(k), 1.0]) for k in range(8)])
    found = retrieve.nearest(rows, rows.select(F.col("chunk_id").alias("query_id"), "embedding"), 2)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 16


def test_no_questions_and_null_vectors(spark):
    rows = corpus(spark, [("a", "s", [1.0, 0.0]), ("b", "s", None)])
    none = spark.createDataFrame([], f"query_id int, scheme_id string, embedding {VEC}")
    assert retrieve.nearest(rows, none, 3).isEmpty()
    one = spark.createDataFrame([(1, "s", [1.0, 0.0]), (2, "s", None)], f"query_id int, scheme_id string, embedding {VEC}")
    assert [(r.query_id, r.chunk_id) for r in retrieve.nearest(rows, one, 3).collect()] == [(1, "a")]


def greedy(c, k, lam):
    if len(c) <= k:
        return list(range(len(c)))
    chosen = [0]
    while len(chosen) < k:
        rest = [i for i in range(len(c)) if i not in chosen]
        score = lambda i: lam * c[i][1] - (1 - lam) * max(float(np.dot(c[i][2], c[j][2])) for j in chosen)
        chosen.append(max(rest, key=lambda i: (score(i), -i)))
    return chosen


@pytest.mark.parametrize("lam", [0.1, 0.7, 1.0])
def test_mmr_against_greedy(spark, lam):
    rng = np.random.default_rng(5)
    cands = []
    for k in range(12):
        v = rng.normal(size=6)
        cands.append((f"c{k}", 1 - k / 20, (v / np.linalg.norm(v)).tolist()))
    rows = [(1, k + 1, *c) for k, c in enumerate(cands)] + [(2, k + 1, *c) for k, c in enumerate(cands[:3])]
    df = spark.createDataFrame(rows, f"query_id int, rank int, chunk_id string, similarity double, body_embedding {VEC}")
    got = retrieve.mmr(df, 5, lam).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got if r.query_id == 1] == [f"c{i}" for i in greedy(cands, 5, lam)]
    assert [(r.chunk_id, r.mmr_score) for r in got if r.query_id == 2] == [(c, s) for c, s, _ in cands[:3]]


def test_alias_boundaries(spark):
    aliases = spark.createDataFrame([("l", "Large Cap"), ("s", "small cap"), ("s", "a+b")], "scheme_id string, alias string")
    texts = ["the large cap fee", "large cap and small cap", "enlarge caps", "what is A+B", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, query string")
    got = [r.scheme_id for r in retrieve.resolve_scheme(df, aliases).orderBy("k").collect()]
    assert got == ["l", None, None, "s", None, None]


@pytest.mark.parametrize("few", [256, 0])
def test_aliases_folded_or_looked_up(spark, few):
    """Patterns per scheme and the join by word say the same as a loop."""
    import random
    import re

    rng = random.Random(3)
    words = ["large", "cap", "caps", "a+b", "é", "x_y", "tax", "fund", "\\E", "++", "Small"]
    aliases = [(f"s{k % 9}", " ".join(rng.choices(words, k=rng.randint(1, 3)))) for k in range(60)] + [("n", None), (None, "cap"), ("w", "₹!"), ("w", "😀"), ("e", "")]
    texts = [None, "", *("".join(rng.choice(words) + rng.choice([" ", " ", ".", "", "-"]) for _ in range(rng.randint(1, 6))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate([*texts, texts[5]])), "k int, query string")
    got = {r.k: r.scheme_id for r in retrieve.resolve_scheme(df, spark.createDataFrame(aliases, "scheme_id string, alias string"), few=few).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate([*texts, texts[5]]):
        hits = {s for s, a in aliases if s and a and re.search(r"(?<!\w)" + re.escape(a.lower()) + r"(?!\w)", (t or "").lower())}
        assert got[k] == (hits.pop() if len(hits) == 1 else None), t


def test_section_dedupe_and_threshold(spark):
    df = spark.createDataFrame([(1, 1, "x", "A", 0.9), (1, 2, "x", "B", 0.8), (1, 3, "y", "A", 0.25), (1, 4, "z", "A", 0.24)], "query_id int, rank int, section string, scheme_name string, similarity double")
    assert [r.rank for r in retrieve.best_of_section(df).orderBy("rank").collect()] == [1, 3, 4]
    assert retrieve.best_of_section(df, ("scheme_name", "section")).count() == 4
    assert retrieve.threshold(df).count() == 3


def test_empty_corpus_raises(spark):
    empty = corpus(spark, []).withColumn("body_embedding", F.col("embedding"))
    with pytest.raises(CorpusEmptyError):
        retrieve.retrieve(empty, empty)


def test_encoder_gives_unit_rows(spark):
    df = spark.createDataFrame([("the expense ratio",), ("",), (None,)], "t string")
    rows = [r.embedding for r in encode(df, "t", dimensions=16).collect()]
    assert np.linalg.norm(rows[0]) == pytest.approx(1, abs=1e-6)
    assert set(rows[1]) == set(rows[2]) == {0.0}
    flat = encode(df, "t", load=lambda: lambda texts: np.ones((len(texts), 4)), dimensions=4).collect()
    assert flat[0].embedding == pytest.approx([0.5] * 4)


def test_refusals_are_cut_off_before_the_search(spark):
    """The plan of the refusal branch has no Python and reads no vector."""
    from citewell import queries
    from citewell.plans import answer

    rows = spark.createDataFrame([(1, "Should I buy?")], "query_id int, query string")
    aliases = spark.createDataFrame(queries.ALIASES, "scheme_id string, alias string")
    manifest = spark.createDataFrame([("l", "L", "https://p.example/l")], "scheme_id string, scheme_name string, url string")
    g = answer.guarded(rows, aliases).withColumn("max_fetched_at", F.lit("d")).withColumn("corpus_fingerprint", F.lit("f"))
    plan = answer.refusals(g, manifest)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_settings_from_session(spark):
    from citewell.config import settings

    spark.conf.set("spark.citewell.top_k", "3")
    spark.conf.set("spark.citewell.use_mmr", "false")
    try:
        s = settings(spark, max_sentences=2)
        assert (s.top_k, s.use_mmr, s.max_sentences, s.over_fetch) == (3, False, 2, Settings.over_fetch)
    finally:
        spark.conf.unset("spark.citewell.top_k")
        spark.conf.unset("spark.citewell.use_mmr")


def test_a_models_double_precision_is_kept(spark):
    """7/40 is not a single: rounded to two places, it must stay on its side."""
    df = spark.createDataFrame([("x",)], "t string")
    row = np.array([[7.0, 39.0, 5.0, 1.0, 2.0]])
    assert np.linalg.norm(row) == 40
    given = encode(df, "t", load=lambda: lambda texts: row, dimensions=5, double=True).first().embedding
    assert given[0] == 0.175


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_looked_up_texts_are_not_shuffled_by_word(spark, monkeypatch, sent):
    monkeypatch.setattr(retrieve, "SENT", sent)
    aliases = spark.createDataFrame([("a", "the"), ("b", "fee of"), ("c", "!!")], "scheme_id string, alias string")
    df = spark.createDataFrame([(1, "the fee"), (2, "a fee of x"), (3, "so !! y"), (4, "the fee of"), (4, "the fee of"), (5, None)], "k int, query string")
    done = retrieve.resolve_scheme(df, aliases, few=0).select("k", "scheme_id")
    assert sorted(map(tuple, done.collect()), key=str) == [(1, "a"), (2, "b"), (3, "c"), (4, None), (4, None), (5, None)]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == bool(sent)
