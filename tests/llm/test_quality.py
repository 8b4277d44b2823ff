import random

import pytest
from pyspark.sql import functions as F

from citewell.llm import quality


def plain(text):
    words = text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")
    words = [w for w in words if w]
    grams = {}
    for k in range(len(words) - 4):
        grams.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + i for at in grams.values() if len(at) > 1 for k in at for i in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measurements_against_loops(docs):
    rng = random.Random(1)
    texts = ["", " \n", "a b c d e f a b c d e", "a " * 40, "😀 é\n😀 é\n\n# |"]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "c", "dd", "é", "#", "|"]) + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\xa0"]) for _ in range(rng.randint(0, 60))))
    rows = quality.measure(docs(list(enumerate(texts)))).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id]), texts[r.doc_id]


def test_odd_rows(odd):
    book = quality.apply_policy(quality.ledger(odd))
    assert book.count() == odd.count()
    got = {r.doc_id: r for r in book.collect()}
    assert got[1].n_words == 0 and not got[1].kept and got[3].n_words == 30000 and got[3].n_repeat_words == 30000


def test_filter_keeps_clean_rows_and_columns(docs, odd):
    clean = " ".join(f"w{k}x" for k in range(30))
    df = docs([(1, clean), (1, clean), (2, "short"), (3, "A!! " * 30), (4, clean.upper())]).withColumn("n_words", F.lit("mine")).withColumn("_w", F.lit(1))
    out = quality.filter_documents(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1, 1]
    assert quality.filter_documents(odd).count() == 0
    assert quality.filter_documents(odd.limit(0)).count() == 0


def test_ablation_counts_sole_failures(docs):
    clean = " ".join(f"w{k}x" for k in range(30))
    df = docs([(1, clean), (2, "short"), (3, clean + " ### ### ### ### ### ### ### ###"), (4, "# " * 5)])
    book = quality.ledger(df)
    for version, policy in quality.POLICIES.items():
        kept = book.where(quality.passes(policy)).count()
        table = {r.rule: r for r in quality.ablation(book, version).collect()}
        assert set(table) == set(policy.rules)
        for name in policy.rules:
            rest = quality.Policy("x", tuple(n for n in policy.rules if n != name))
            assert table[name].n_kept == kept and table[name].n_kept_without == book.where(quality.passes(rest)).count()


@pytest.mark.parametrize("version", quality.POLICIES)
def test_empty_table(odd, version):
    assert quality.ablation(quality.ledger(odd.limit(0)), version).count() == 0
