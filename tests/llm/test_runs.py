"""Runs of words against trying every period, and the query against the same."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from citewell.llm import runs


def plain_runs(x, least=6, times=4):
    """Every period, every stretch; of equal stretches the smallest period."""
    best = {}
    for p in range(1, len(x) // times + 1):
        i = 0
        while i + p < len(x):
            if x[i] != x[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            if i + p - s >= max(least, times * p):
                best.setdefault((s, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def made_up(rng):
    k, n = rng.choice([1, 2, 3, 5]), rng.choice([0, 1, 5, 20, 60, 150])
    x = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.7:
        y = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(n)
            y += x[a : a + rng.randint(1, 9)] * rng.randint(1, 7)
            if y and rng.random() < 0.4:
                c = rng.randrange(len(y))
                y += y[c : c + 40]
        x = y
    return x


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (6, 3)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(300):
        docs = [np.array(made_up(rng), dtype=np.int64) for _ in range(rng.randint(1, 5))]
        assert runs.all_runs(docs, least, times) == [plain_runs(d.tolist(), least, times) for d in docs]


def test_ranks_factors_and_blocks():
    rng = random.Random(4)
    for _ in range(100):
        x = made_up(rng)
        n = len(x)
        if not n:
            continue
        ranks = runs.Ranks(np.array(x), np.full(n, n))
        assert ranks.order.tolist() == sorted(range(n), key=lambda i: x[i:])
        same = lambda i, j: next((k for k in range(n - max(i, j)) if x[i + k] != x[j + k]), n - max(i, j))  # noqa: B023, E731
        factor, source = runs.previous_factors(ranks)
        for i in range(n):
            assert factor[i] == max((same(j, i) for j in range(i)), default=0)
            assert source[i] == -1 if not factor[i] else (source[i] < i and same(int(source[i]), i) == factor[i])
        cuts = runs.blocks(0, n, factor.tolist())
        assert cuts[0] == 0 and cuts[-1] == n and all(b - a == max(1, factor[a]) for a, b in zip(cuts, cuts[1:], strict=False))


def test_long_texts_are_nearly_linear():
    assert runs.all_runs([np.zeros(200_000, dtype=np.int64)]) == [[(0, 200_000, 1)]]
    assert runs.all_runs([np.tile(np.arange(1000), 300)]) == [[(0, 300_000, 1000)]]


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {k for s, length, p in found for k in range(s + p, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(found), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_against_every_period(spark, docs, odd, tmp_path):
    rng = random.Random(6)
    rows = [(k, " ".join(f"w{x}" for x in made_up(rng)) + rng.choice(["", "\n", "\x1c é"])) for k in range(400)]
    made = docs(rows).unionByName(odd)
    made.write.parquet(str(tmp_path / "documents.parquet"))
    got = runs.op13_runs(spark, str(tmp_path)).collect()
    want = [(r.doc_id, *expected(r.doc_id, r.text)) for r in made.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.n_runs > 0 for r in got) > 100


def test_batches_do_not_matter(spark, docs, monkeypatch):
    rows = docs([(k, "a b c " * (k % 9)) for k in range(50)])
    one = sorted(map(tuple, runs.document_runs(rows).collect()), key=str)
    monkeypatch.setattr(runs, "BATCH_WORDS", 7)
    assert sorted(map(tuple, runs.document_runs(rows).collect()), key=str) == one


def test_empty_table_and_clashing_names(spark, docs):
    assert runs.document_runs(docs([])).collect() == []
    clash = docs([(1, "x " * 8)]).withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed")
    (row,) = runs.document_runs(clash).collect()
    assert [tuple(r) for r in row.runs] == [(0, 8, 1)] and row.collapsed == "x"
