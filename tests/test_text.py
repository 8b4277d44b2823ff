import random
import re

import pytest
from pyspark.sql import functions as F

from citewell.functions import text

L = F.lit


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("  a b\n“c” – d‌ ", 'a b "c" - d'),
        ("", ""),
        (" \n\t", ""),
        ("it’s − 5", "it's - 5"),
    ],
)
def test_normalize_ws(value, given, wanted):
    assert value(text.normalize_ws(L(given))) == wanted


def test_normalize_ws_of_null_is_empty(value):
    assert value(text.normalize_ws(L(None).cast("string"))) == ""


def test_normalize_lines_drops_blank_lines(value):
    assert value(text.normalize_lines(L("a  b\r\n\n \x0bc d"))) == "a b\nc\nd"


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("The ratio is 1.23% now. Next one.", ["The ratio is 1.23% now.", "Next one."]),
        ("Pay Rs. 500 today. See e.g. This page.", ["Pay Rs. 500 today.", "See e.g. This page."]),
        ("Dr. Who came. and left.", ["Dr. Who came. and left."]),
        ("Label\n5%\nOther", ["Label", "5%", "Other"]),
        ("It was 1. 23 then.", ["It was 1. 23 then."]),
        ("Really?! Yes… No", ["Really?!", "Yes…", "No"]),
        ("approx.\n\nFoo", ["approx.\n\nFoo"]),
        ("   ", []),
    ],
)
def test_split_sentences(value, given, wanted):
    assert value(text.split_sentences(L(given))) == wanted


def plain_sentences(s):
    """The rules as a loop over boundaries."""
    out, start = [], 0
    for m in re.finditer(r"(?<=[.!?…])[ \t]+|\n+", s):
        i = m.start()
        k = i
        while k and s[k - 1] in " \t":
            k -= 1
        if k and s[k - 1] in ".!?…":
            run = k
            while run and s[run - 1] in ".!?…":
                run -= 1
            nxt = i
            while nxt < len(s) and s[nxt] in " \t":
                nxt += 1
            after = s[nxt] if nxt < len(s) else ""
            token = re.search(r"[A-Za-z][A-Za-z.]*$", s[:k])
            word = token[0].rstrip(".").lower() if token else ""
            if (run and s[run - 1].isdigit() and after.isdigit()) or word in text.ABBREVIATIONS or after.islower():
                continue
        if piece := s[start:i].strip():
            out.append(piece)
        start = m.end()
    return out + ([s[start:].strip()] if s[start:].strip() else [])


def test_split_sentences_on_random_text(spark):
    rng = random.Random(1)
    parts = ["A", "b", "Mr", "no", "e.g", "fy", "1", "23", ".", ".", "!", "?", "…", " ", "  ", "\n", "\n\n", "\t", "é", "É"]
    given = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(s,) for s in given], "s string")
    found = df.select("s", text.split_sentences("s").alias("x")).collect()
    assert [(r.s, r.x) for r in found if r.x != plain_sentences(r.s)] == []


def test_truncate_keeps_what_fits(value):
    assert tuple(value(text.truncate_sentences(L("A b.  C d."), 2))) == ("A b.  C d.", 2)
    assert tuple(value(text.truncate_sentences(L("A b. C d. E f."), 2))) == ("A b. C d.", 3)
    assert tuple(value(text.truncate_sentences(L("A b. C d."), 0))) == ("", 2)


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("https://www.Site.example/Path/x/?utm_source=a&b=2&a=1&ref=q#part.", "site.example/Path/x?a=1&b=2"),
        ("HTTP://a.example/", "a.example"),
        ("https://a.example#x?y=1", "a.example/?y=1"),
        ("  https://a.example/b】", "a.example/b"),
        ("", ""),
        ("www.a.example/B", "a.example/B"),
    ],
)
def test_normalize_url(value, given, wanted):
    assert value(text.normalize_url(L(given))) == wanted


def test_extract_urls(value):
    given = "see [x](https://a.example/b) and https://c.example/d. Then (https://a.example/b), https://e.example/f】"
    assert value(text.extract_urls(L(given))) == ["https://a.example/b", "https://c.example/d", "https://e.example/f"]


def test_extract_numbers(value):
    given = "Rs. 1,23,456 then ₹500 or 1.23 %, 5% in 3 years, 1,23,456 and 3.5, again 5%"
    assert value(text.extract_numbers(L(given))) == ["Rs. 1,23,456", "₹500", "1.23 %", "5%", "3 years", "1,23,456", "3.5"]


def test_strip_number(value):
    assert value(text.strip_number(L("It is 5% , then 5%."), L("5%"))) == "It is, then 5%."
    assert value(text.strip_number(L("5%"), L("5%"))) == ""
    assert value(text.strip_number(L("a"), L(""))) == "a"


def test_canonical_number(value):
    assert value(text.canonical_number(L("1.04 % of (x )"))) == "1.04% of (x)"


def test_mangled(value):
    assert value(text.looks_mangled(L("The ratio is .")))
    assert value(text.looks_mangled(L("It is if held")))
    assert not value(text.looks_mangled(L("The ratio holds well.")))


def test_match_spans(value):
    assert [tuple(m) for m in value(text.match_spans(L("é12 x 345"), r"\d+"))] == [("12", 1, 3), ("345", 6, 9)]


def test_small_helpers(value):
    assert value(text.count_tokens(L("abcde"))) == 2
    assert value(text.strip_context_header(L("[Scheme: a]\nbody"))) == "body"
    assert value(text.amounts_match(L(1000.5), L(1000.0)))
    assert value(text.without_freshness(L("A b. Last updated from sources: 2026-01-31"))) == "A b."


def test_bare_labels_have_no_decimal_digit(spark):
    starts = (ord("0"), 0x0660, 0xFF10, 0x11F50, 0x16AC0, 0x1E4F0)
    given = [(f"a{chr(k + i)}", not 0 <= i < 10) for k in starts for i in range(-1, 11)] + [("Rating", True), ("", True)]
    rows = spark.createDataFrame(given, "x string, bare boolean")
    assert rows.where(text.is_bare_label(F.col("x")) != F.col("bare")).collect() == []


def test_tokens_counted_by_a_tokenizer(spark):
    from citewell.config import Settings

    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    counted = df.select(text.count_tokens_with("t", lambda: lambda texts: [len(x.split()) for x in texts]).alias("n"))
    assert [r.n for r in counted.collect()] == [3, 0]
    assert not Settings().tokens_are_exact


def test_functions_in_sql(spark):
    """Each SQL function says what its expression says."""
    from citewell.functions import sql

    names = sql.register(spark)
    texts = ["", None, "The ratio is 1.04 %", "Rs. 1,200", "[Scheme: a]\nbody", "is if the", "me a@b.co x", "Last updated from sources: d", "12"]
    rows = spark.createDataFrame([(x, "b", "c", "d", 1000.0, 1000.9) for x in texts], "x string, y string, z string, w string, a double, b double")
    rows.createOrReplaceTempView("texts")
    assert len(names) == len(sql.FUNCTIONS)
    for name, parameters, build in sql.FUNCTIONS:
        args = ("a", "b") if parameters[0][1] == "DOUBLE" else ("x", "y", "z", "w")[: len(parameters)]
        want = [r[0] for r in rows.select(build(*map(F.col, args))).collect()]
        assert [r[0] for r in spark.sql(f"SELECT {name}({', '.join(args)}) FROM texts").collect()] == want, name
