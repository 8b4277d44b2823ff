"""Consistent weighted sampling: against the formula in loops, and against exact likeness."""

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from citewell.llm import weighted as w


def _hash(*values, seed=42):
    """Spark's 64-bit hash of longs and ints."""
    for v, size in values:
        seed = xxh64_intdigest((v % (1 << (8 * size))).to_bytes(size, "little"), seed)
    return seed


def plain_fingerprint(text):
    terms = Counter(text.encode().split() or [b""])
    cells = [(k + 0.5) / w.CELLS for k in range(w.CELLS)]
    quantiles = [w.gamma_quantile(u) for u in cells]
    out, total = "", sum(terms.values())
    hashed = Counter()
    for word, n in terms.items():
        h = xxh64_intdigest(word, 42)
        hashed[(h - (h >> 63 << 64)) >> 1] += n
    bits = w.CELLS.bit_length() - 1
    for sample in range(w.SAMPLES):
        block, k = divmod(sample, w.BLOCK)
        best = None
        for term, n in hashed.items():
            x = _hash((_hash((term, 8), (block, 4)) ^ ((k + 1) * w.STEP % (1 << 63)), 8))
            y = _hash((x, 8))
            r, b = quantiles[x & (w.CELLS - 1)], float(x >> bits) * 2.0 ** (bits - 64)
            cell = y >> (64 - bits)
            c = math.sqrt((float(y >> 11) + 0.5) * 2.0**-53) * (quantiles[cell] / math.sqrt(cells[cell]))
            t = math.floor(math.log(n) / r + b)
            code = math.floor(min(c * math.exp(-r * (t - b + 1.0)) * (total * w.SCALE), w.MOST))
            value = (code, _hash((x ^ (t % (1 << 64)), 8)) & 0xFFFFFFFF)
            best = value if best is None else min(best, value)
        out += f"{best[1]:08x}"
    return out


def alike(a, b):
    """Generalised Jaccard similarity of word counts."""
    a, b = Counter(a.split() or [""]), Counter(b.split() or [""])
    return sum((a & b).values()) / sum((a | b).values())


def share(a, b):
    return sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / w.SAMPLES


def test_fingerprints_are_those_of_the_formula(docs, odd):
    rng = random.Random(1)
    texts = ["", "a", "a a a b", "é 😀 é\n\x1cx", " ".join(rng.choice("abcdefgh") for _ in range(300))]
    got = {r.doc_id: r.fingerprint for r in w.fingerprints(docs(list(enumerate(texts)))).collect()}
    assert got == {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    rows = w.fingerprints(odd)
    assert rows.count() == odd.count() and w.fingerprints(docs([])).collect() == []


def test_quantiles():
    for u in (1e-6, 0.1, 0.5, 0.9, 0.9999):
        x = w.gamma_quantile(u)
        assert abs(1 - (1 + x) * math.exp(-x) - u) < 1e-9


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(2)
    pairs, exact = [], []
    for k in range(500):  # words of their own, so that pairs are independent
        a = {f"{k}-{j}": rng.choice([0, 1, 1, 2, 3, 9]) for j in range(12)}
        b = {t: n if rng.random() < 0.5 else rng.choice([0, 1, 2, 5]) for t, n in a.items()}
        one, two = (" ".join(t for t, n in x.items() for _ in range(n)) for x in (a, b))
        pairs.append((k, one, two))
        exact.append(alike(one, two))
    rows = w.signatures(spark.createDataFrame(pairs, "k bigint, a string, b string"), ("k",), ("a", "b"))
    got = {r.k: r.near for r in rows.select("k", w.likeness("s0", "s1").alias("near")).collect()}
    errors = [got[k] - exact[k] for k in range(500)]
    assert abs(sum(errors) / 500) < 0.012  # three deviations of the mean
    assert math.sqrt(sum(e * e for e in errors) / 500) < 1.2 * math.sqrt(sum(x * (1 - x) for x in exact) / 500 / w.SAMPLES)


def test_query_against_loops(spark, docs, odd, tmp_path):
    rng = random.Random(3)
    rows = [(k * 3, " ".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 3, 40])))) for k in range(60)]
    table = docs(rows).unionByName(odd.where("doc_id IS NULL OR doc_id <> 3")).withColumn("k1", F.lit("clash"))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = w.op11_weighted(spark, str(tmp_path)).collect()
    assert len(got) == table.count()
    distinct = {(r.doc_id, r.text or "") for r in table.collect()}
    texts = dict(distinct)
    order = sorted(i for i in texts if i is not None)
    sure = [i for i in order if sum(i == d for d, _ in distinct) == 1]
    by = {r.doc_id: r for r in got}
    for i, after in zip(sure, sure[1:], strict=False):
        if order[order.index(i) + 1] != after:
            continue
        text, q = texts[i], len(texts[i]) // 4
        edited = text[: len(text) - q] + texts[after][:q]
        r, one, two = by[i], plain_fingerprint(text), plain_fingerprint(edited)
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), one, two, share(one, two), share(one, plain_fingerprint(texts[after])))
        assert tuple(r)[1:] == want


def test_an_only_document_follows_itself(spark, docs, tmp_path):
    docs([(7, "one two three four")]).write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = w.op11_weighted(spark, str(tmp_path)).collect()
    assert (r.n_chars, r.near_next, r.edited_sha256) == (18, 1.0, hashlib.sha256(b"one two three one ").hexdigest())
    docs([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert w.op11_weighted(spark, str(tmp_path / "none")).collect() == []
