"""Queries against their SQL on small made tables, where odd texts stand."""

import random
from collections import Counter

import duckdb
import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def differences(spark, tmp_path):
    """Rows that only the query or only its SQL has, of documents (text, or id, text, lang and source)."""
    import __spark_entry__ as entry

    def of(name, documents):
        rows = [d if isinstance(d, tuple) else (k, d, "en", "src1") for k, d in enumerate(documents)]
        path = f"{tmp_path}/{name}"
        spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCUMENT).coalesce(1).write.parquet(f"{path}/documents.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
        found = entry.queries()[name](spark, path)
        said = db.execute(entry.oracle_sql()[name])
        assert [c[0] for c in said.description] == found.columns
        mine, theirs = Counter(map(tuple, found.collect())), Counter(said.fetchall())
        assert theirs
        return list((mine - theirs).elements()), list((theirs - mine).elements())

    return of


def texts(n, parts, most=14, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(parts, k=rng.randint(1, most))) for _ in range(n)]


PARTS = ["A", "b", "Mr", "no", "no. ", "No. ", "e.g", "fy", "1", "2. ", "3", ".", ".", "!", "?", "…", " ", "  ", "\n", "\n\n", "\t", "é", "É", "ſ"]
PARTS += ["", "", "﷐", "\xa0", "\r\n", "\x1f", "‌"]


def test_sentences_docs_two_abbreviations_in_a_row(differences):
    given = ["Say no no. No. Ñ ends. Mr. Dr.\nWho", "It was 1. 2. 3 then. . B", "a. B. C", None, "", " \n"]
    assert differences("sentences_docs", given + texts(3000, PARTS)) == ([], [])


def test_truncate_docs_two_abbreviations_in_a_row(differences):
    given = ["Say no no. No. Ñ ends. And. More.", "It was 1. 2. 3 then. So. On.", None, ""]
    assert differences("truncate_docs", given + texts(500, PARTS, seed=2)) == ([], [])


#: Documents without text, source or language, with ids of any size, and with a text that has a header's mark.
BARE = [(7, "A b.", None, "s"), (8, "A b.", "en", None), (10**15 + 1, "A b.\nC", "en", "s"), (-3, "A b.", "", " "), (9, None, "en", "s"), (11, "", "en", "s"), (12, " \n\t", "en", "s"), (13, "see [Scheme: x", "en", "s"), (14, "see [Scheme: x", "e  n", "a\xa0 b"), (17, "[Scheme: x", "en", "s")]
WORDS = ["A long word ", "no no. No. ", "Fee: 1.2%\n", "x½²: 5\n", "éte: 5\n", "Fee\n", "٣٫٤\n", "₹٣٤\n", "\t12\t\n", "Rs. 5\n", "+1,000\x1f%\n", "12\xa0%\n", "Fee ٣\n", "ſ", "Mr. ", "1. 2. 3 ", "So it ends. ", "and on! ", "\n", "w" * 700 + " ", "‌", ""]


@pytest.mark.parametrize("name", ["chunk_counted", "chunk_windows", "chunk_reports", "chunk_index", "chunk_violations", "line_shapes"])
def test_odd_documents(differences, name):
    rows = BARE + [(1000 + k, t, "en", "src1") for k, t in enumerate(texts(150, WORDS, 25, seed=3) + texts(20, WORDS, 600, seed=4))]
    assert differences(name, rows) == ([], [])
