import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "word " * 30000
    rows = [
        (1, None, None, None), (2, "", "en", ""), (3, long), (4, "a b c"), (4, "a b c"), (None, "no id"), (None, None, None, None),
        (5, "\x00 \t\n", "en", "s"), (6, "😀 e\u0301", "fr", None), (7, "A b C"),
    ]
    return docs(rows)
