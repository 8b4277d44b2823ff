import math
import random

from pyspark.sql import functions as F

from citewell.config import Settings
from citewell.operators import chunking
from test_text import plain_sentences

S = Settings()


def tokens(s):
    return math.ceil(len(s) / 4)


def label(line):
    return not any(c.isdigit() for c in line)


def plain_pack(lines, max_chars, max_tokens):
    parts, start = [], 0
    while start < len(lines):
        end = start + 1
        for e in range(start + 1, len(lines) + 1):
            joined = "\n".join(lines[start:e])
            if len(joined) <= max_chars and tokens(joined) <= max_tokens:
                end = e
        if end < len(lines) and not label(lines[end]):
            if end - start == 1 and label(lines[start]):
                end += 1
            elif end - start > 1 and label(lines[end - 1]):
                end -= 1
        parts.append("\n".join(lines[start:end]))
        start = end
    return parts


def plain_group(words, target, most):
    runs, now, n = [], [], 0
    for w in words:
        if now and n + tokens(w) > most:
            runs.append(" ".join(now))
            now, n = [], 0
        now.append(w)
        n += tokens(w)
        if n >= target:
            runs.append(" ".join(now))
            now, n = [], 0
    return runs + ([" ".join(now)] if now else [])


def plain_windows(text, target, overlap):
    windows, now, n = [], [], 0
    for s in plain_sentences(text):
        if now and n + tokens(s) > target:
            windows.append(" ".join(now))
            carry, c = [], 0
            for p in reversed(now):
                if c + tokens(p) > overlap:
                    break
                carry.insert(0, p)
                c += tokens(p)
            now, n = carry, c
        now.append(s)
        n += tokens(s)
    if now and (not windows or windows[-1] != " ".join(now)):
        windows.append(" ".join(now))
    return windows


def test_pack_lines_against_loop(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        lines = [("v 5" if rng.random() < 0.4 else "label") + "x" * rng.randint(0, 40) for _ in range(rng.randint(0, 30))]
        rows.append((k, lines, rng.randint(20, 120), rng.randint(5, 40)))
    df = spark.createDataFrame(rows, "k int, lines array<string>, c int, t int")
    found = df.select("k", chunking.pack_lines(F.col("lines"), F.col("c"), F.col("t")).alias("p")).collect()
    assert {r.k: r.p for r in found} == {k: plain_pack(ls, c, t) for k, ls, c, t in rows}


def test_prose_and_windows_against_loops(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        sentences = [" ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(1, 25))).capitalize() + "." for _ in range(rng.randint(0, 30))]
        texts.append(" ".join(sentences))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.select(
        "k",
        chunking.split_prose(F.col("t"), F.lit(100), F.lit(120)).alias("prose"),
        chunking.sliding_windows(F.col("t"), F.lit(60), 20).alias("windows"),
    ).collect()
    for r in got:
        t = texts[r.k]
        assert r.prose == ([] if not t else [t] if tokens(t) <= 120 else plain_group(t.split(), 100, 120))
        assert r.windows == plain_windows(t, 60, 20)


def document(spark, *sections):
    rows = [tuple(s) + (k,) for k, s in enumerate(sections)]
    return spark.createDataFrame(
        [("a", "A Fund", "cat", "Direct", "https://p.example/a", "2026-01-31", "h", "m", [(t, 2, x, b, k) for t, x, b, k in rows])],
        "scheme_id string, scheme_name string, category string, plan string, source_url string, fetched_at string, "
        "content_sha256 string, extraction_mode string, sections array<struct<section_title:string,heading_level:int,text:string,is_table:boolean,order:int>>",
    )


def test_small_sections_merge_but_not_across_kinds(spark):
    doc = document(spark, ("A", "short one", False), ("B", "short two", False), ("T", "x 1", True), ("C", "last", False))
    (m,) = (r.m for r in doc.select(chunking.merge_small_sections(F.col("sections")).alias("m")).collect())
    assert [(s.section_title, s.text, s.order) for s in m] == [("A / B", "short one\nshort two", 0), ("T", "x 1", 2), ("C", "last", 3)]


def test_chunks_are_numbered_deduplicated_and_within_limit(spark):
    prose = " ".join(f"Sentence number {k} says something of its own here." for k in range(60))
    table = "\n".join(f"Label {k}\n{k}.5%" for k in range(100))
    doc = document(spark, ("P", prose, False), ("Q", prose, False), ("T", table, True))
    rows = sorted(chunking.chunk_documents(doc).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert len({r.content_sha256 for r in rows if not r.is_table}) == sum(not r.is_table for r in rows)
    assert all(r.section != "Q" for r in rows)
    assert all(tokens(r.embed_text) <= S.chunk_max_tokens for r in rows if r.is_table)
    assert sum(len(r.display_text.split("\n")) for r in rows if r.is_table) == 200
    assert all(r.embed_text == f"[Scheme: A Fund | Category: cat | Plan: Direct | Section: {r.section}]\n{r.display_text}" for r in rows)
    again = sorted(chunking.chunk_documents(doc).collect(), key=lambda r: r.chunk_index)
    assert rows == again


def test_violations(spark):
    good = document(spark, ("P", "Some text of a section.", False))
    chunks = chunking.chunk_documents(good)
    assert chunking.violations(chunks).isEmpty()
    bad = chunks.withColumn("section", F.lit(" ")).withColumn("display_text", F.lit("[Scheme: x")).withColumn("embed_text", F.lit("x" * 2000))
    assert {r.violation for r in chunking.violations(bad).collect()} == {"over_limit", "no_header", "header_leak", "empty_section"}


def test_document_without_sections_has_no_chunks(spark):
    assert chunking.chunk_documents(document(spark)).isEmpty()
