"""Chunks by a tokenizer's counts against loops, and folds in time that follows the length."""

import random
import time

import pytest
from pyspark.sql import functions as F

import test_chunking as plain
from citewell.config import Settings
from citewell.errors import ConfigError
from citewell.operators import chunking, folds, tokens
from citewell.schemas import DOCUMENT
from test_chunking import plain_group, plain_pack, plain_windows

RULE = Settings(tokenizer="pieces:3")


def rule(text):
    return sum(-(-len(w) // 3) for w in text.split())


def header(section):
    return f"[Scheme: S | Category: c | Plan: p | Section: {section}]"


def plain_chunks(sections):
    """(section, body) of the chunks of (title, text, is_table) sections."""
    merged, out, seen = [], [], set()
    for title, text, table in sections:
        if merged and rule(merged[-1][1]) < 40 and merged[-1][2] == table and rule(merged[-1][1] + "\n" + text) <= 240:
            merged[-1] = (merged[-1][0] + " / " + title, merged[-1][1] + "\n" + text, table)
        else:
            merged.append((title, text, table))
    for title, text, table in merged:
        most = max(1, 240 - rule(header(title)) - 1)
        target = min(200, most)
        if table:
            bodies = plain_pack([x for x in text.split("\n") if x.strip()], 1800, most)
        else:
            norm = " ".join(text.split())
            runs = [norm] if rule(norm) <= most else plain_group(norm.split(" "), target, most)
            bodies = [w for r in runs for w in plain_windows(r, target, 60)]
        for b in bodies:
            if table or b not in seen:
                out.append((title, b))
                seen.add(b) if not table else None
    return out


def test_a_tokenizer_changes_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(plain, "tokens", rule)
    rng = random.Random(7)
    docs, want = [], {}
    for k in range(25):
        sections = []
        for j in range(rng.randint(1, 5)):
            if rng.random() < 0.4:
                text = "\n".join(rng.choice([f"Row {i}", f"{i} 5%", "Label", f"value {i}"]) + " xy" * rng.randint(0, 12) for i in range(rng.randint(1, 60)))
                sections.append((f"T{j}", text, True))
            else:
                words = [rng.choice(["alpha", "b", "gammagamma", "No.", "end.", "So"]) for _ in range(rng.randint(1, 500))]
                sections.append((f"P{j}", " ".join(words), False))
        rows = [(t, 2, x, is_table, i) for i, (t, x, is_table) in enumerate(sections)]
        docs.append((str(k), "S", "c", "p", f"u{k}", "2026-01-31", "h", rows))
        want[str(k)] = plain_chunks(sections)
    names = ("scheme_id", "scheme_name", "category", "plan", "source_url", "fetched_at", "content_sha256", "sections")
    table = spark.createDataFrame([tuple(dict(zip(names, d, strict=True)).get(f.name) for f in DOCUMENT) for d in docs], DOCUMENT)
    chunks = chunking.chunk_documents(table, RULE)
    got = {}
    for r in chunks.orderBy("scheme_id", "chunk_index").collect():
        got.setdefault(r.scheme_id, []).append((r.section, r.display_text))
    assert got == want
    assert {(r.scheme_id, r.display_text) for r in chunking.chunk_documents(table).collect()} != {(k, b) for k, cs in want.items() for _, b in cs}
    report = {r.scheme_id: r.max_tokens for r in chunking.chunk_report(chunks, RULE).collect()}
    assert report == {k: max(rule(header(s) + " " + b) for s, b in cs) for k, cs in want.items()}
    assert chunking.violations(chunks, RULE).where("violation = 'over_limit'").count() == sum(rule(header(s) + " " + b) > 240 for cs in want.values() for s, b in cs)


def test_tokenizers_by_name(spark):
    assert RULE.tokens_are_exact and not Settings().tokens_are_exact
    with pytest.raises(ConfigError):
        chunking.chunk_documents(spark.createDataFrame([], DOCUMENT), Settings(tokenizer="nosuch:1"))
    tokens.register("constant", lambda rest: lambda words: [int(rest)] * len(words))
    try:
        rows = tokens.sized(spark.createDataFrame([("a b  c",), ("",), (None,)], "t string"), "t", "n", Settings(tokenizer="constant:7"))
        assert [r.n for r in rows.collect()] == [21, 0, 0]
    finally:
        del tokens.LOADERS["constant"]


def test_a_real_model_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text = "Fact sheets say 5% of them. Überraschung!"
    rows = tokens.sized(spark.createDataFrame([(text,)], "t string"), "t", "n", Settings(tokenizer=f"sentencepiece:{path}"))
    assert rows.first().n == sum(len(model.encode(w)) for w in text.split())


def test_running_sums_over_blocks(spark):
    for n in (0, 1, folds.BLOCK, folds.BLOCK + 1, 3 * folds.BLOCK - 1):
        a = [k % 7 for k in range(n)]
        got = spark.createDataFrame([(a,)], "a array<int>").select(folds.running(F.col("a")).alias("r")).first().r
        assert got == [sum(a[:k]) for k in range(n + 1)]


@pytest.mark.parametrize("what", ["pack", "windows", "dedupe", "merge"])
def test_time_follows_the_length(spark, what):
    lines = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("Line "), i.cast("string"), F.lit(" here.")))
    rows = spark.createDataFrame([(20_000,), (200_000,)], "n int").withColumn("lines", lines)
    section = F.transform("lines", lambda x, i: F.struct(x.alias("section_title"), F.lit(2).alias("heading_level"), x.alias("text"), F.lit(False).alias("is_table"), i.alias("order")))
    piece = F.transform("lines", lambda x: F.struct(F.lit(False).alias("is_table"), x.alias("body")))
    made = {
        "pack": lambda: chunking.pack_lines(F.col("lines"), F.lit(1800), F.lit(200)),
        "windows": lambda: chunking.sliding_windows(F.array_join("lines", " "), F.lit(200), 60),
        "dedupe": lambda: chunking.dedupe_pieces(piece),
        "merge": lambda: chunking.merge_small_sections(section),
    }[what]()

    def took(n):
        start = time.monotonic()
        (r,) = rows.where(F.col("n") == n).select(F.size(made).alias("k")).collect()
        return time.monotonic() - start, r.k

    took(20_000)
    small, few = min(took(20_000) for _ in range(2))
    large, many = took(200_000)
    assert 9 < many / few < 13
    assert large < 25 * small + 3  # a quadratic fold takes a hundred times as long


def test_words_are_counted_as_arrays(spark, monkeypatch):
    """Nulls, empty lists and repeated words, over several blocks of rows; strings are made
    of distinct words only."""
    lists = [None, [], [[]], [None, ["a", "bbbb", "a"]], [["cc"], [], ["a" * 7, "a"]]] * 5
    df = spark.createDataFrame(list(enumerate(lists)), "k int, w array<array<string>>").coalesce(1)
    monkeypatch.setattr(tokens, "ROWS", 3)
    got = {r.k: r.n for r in tokens.counted(df, F.col("w"), "n", RULE).collect()}
    assert got == {k: None if x is None else [[-(-len(w) // 3) for w in ws or ()] for ws in x] for k, x in enumerate(lists)}
