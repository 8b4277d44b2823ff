"""Chunks from documents, as folds over the arrays that a document holds.

The steps are: small sections merged into the next; tables packed by lines with
labels kept next to their values; prose packed by words and windowed by sentences
with an overlap; repeated prose dropped; pieces numbered through the document.
All of it is one projection: rows are never regrouped. Sequential rules give out places where
an array is cut, in time proportional to its length; texts are joined afterwards.

Tokens are estimated from characters, or counted by the tokenizer in the settings, which must
count a text as the sum of its words between white space, as word-piece models do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.config import Settings
from citewell.functions.text import (
    body_budget,
    context_header,
    count_tokens,
    is_bare_label,
    let,
    normalize_lines,
    normalize_ws,
    split_lines,
    split_sentences,
    strip,
)
from citewell.operators.folds import INTS, cut, emitted, ints, running
from citewell.operators.tokens import counted, sized

PARTS = "array<string>"
SECTION = "struct<section_title:string,heading_level:int,text:string,is_table:boolean,order:int>"
COUNTED = SECTION[:-1] + ",tokens:array<int>>"
RUN = "struct<text:string,tokens:array<int>>"
MARK = "[Scheme:"


def _empty() -> Column:
    return F.array().cast(PARTS)


def _words(text: Column) -> Column:
    """Words between white space, the same in a text and in its normalised lines and sentences."""
    return let(normalize_ws(text), lambda t: F.when(t == "", _empty()).otherwise(F.split(t, " ", -1)))


def _sizes(parts: Column, counts: Column | None, chars: int) -> Column:
    """Tokens of each part: estimated, or from the counts of the words that the parts, one
    after another, are made of."""
    if counts is None:
        return F.transform(parts, lambda x: count_tokens(x, chars))
    ends = running(F.transform(parts, lambda x: F.size(_words(x))))
    return let(
        F.struct(ends.alias("e"), running(counts).alias("t")),
        lambda b: F.transform(parts, lambda _, k: (F.get(b["t"], F.get(b["e"], k + 1)) - F.get(b["t"], F.get(b["e"], k))).cast("int")),
    )


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda acc, n: acc + n)


def merge_small_sections(sections: Column, s: Settings = Settings(), counts: Column | None = None) -> Column:
    """A section under the minimum takes in the next ones, unless one is a table and
    the other not, or both together are too long. ``counts`` has, for each section, the tokens
    of its words; then those of a merged section are in ``tokens``."""
    kind = "struct<size:int,table:boolean>"

    def of(all_: Column) -> Column:
        length = lambda i: F.length(F.coalesce(F.get(all_, i)["text"], F.lit("")))
        own = (lambda i: length(i)) if counts is None else (lambda i: _total(F.get(counts, i)))
        tokens = (lambda n: F.ceil(n / F.lit(s.chars_per_token))) if counts is None else (lambda n: n)
        gap = 1 if counts is None else 0  # the line feed between two texts

        def step(open_: Column, i: Column) -> tuple[Column, Column]:
            def both(size: Column) -> Column:
                table = F.get(all_, i)["is_table"]
                joined = open_["size"] + gap + size
                takes = (tokens(open_["size"]) < s.min_section_tokens) & (open_["table"] == table) & (tokens(joined) <= s.chunk_max_tokens)
                takes = (i == 0) | F.coalesce(takes, F.lit(False))
                now = F.when((i > 0) & takes, F.struct(joined.cast("int").alias("size"), open_["table"].alias("table")))
                now = now.otherwise(F.struct(size.cast("int").alias("size"), table.alias("table"))).cast(kind)
                return F.struct(now.alias("now"), F.when(takes, ints()).otherwise(ints(i)).alias("out"))

            made = let(own(i), both)
            return made["now"], made["out"]

        zero = F.struct(F.lit(0).alias("size"), F.lit(False).alias("table")).cast(kind)
        n = F.size(all_)
        ends = F.concat(emitted(n, zero, step, kind)["out"], ints(n))

        def merged(ends: Column) -> Column:
            def section(end: Column, k: Column) -> Column:
                start = F.when(k == 0, 0).otherwise(F.get(ends, k - 1))
                part = F.slice(all_, start + 1, end - start)
                first = F.get(all_, start)
                fields = [
                    F.array_join(F.transform(part, lambda x: x["section_title"]), " / ").alias("section_title"),
                    first["heading_level"].alias("heading_level"),
                    F.array_join(F.transform(part, lambda x: x["text"]), "\n").alias("text"),
                    first["is_table"].alias("is_table"),
                    first["order"].alias("order"),
                ]
                if counts is None:
                    return F.struct(*fields).cast(SECTION)
                return F.struct(*fields, F.flatten(F.slice(counts, start + 1, end - start)).alias("tokens")).cast(COUNTED)

            return F.transform(ends, section)

        none = F.array().cast(f"array<{SECTION if counts is None else COUNTED}>")
        return F.when(n > 0, let(ends, merged)).otherwise(none)

    return let(sections, of)


def pack_lines(lines: Column, max_chars: Column, max_tokens: Column, chars: int = 4, counts: Column | None = None) -> Column:
    """Longest runs of lines within both budgets; a cut between a label and its
    value moves by one line. A line over budget stays whole."""
    kind = "struct<start:int>"

    def of(lines: Column) -> Column:
        n = F.size(lines)
        label = F.transform(lines, is_bare_label)
        sizes = F.lit(None).cast("array<int>") if counts is None else running(_sizes(lines, counts, chars))
        known = F.struct(running(F.transform(lines, lambda x: F.length(x) + 1)).alias("chars"), sizes.alias("tokens"), label.alias("label"))

        def cuts(k: Column) -> Column:
            def fits(start: Column, end: Column) -> Column:
                size = F.get(k["chars"], end) - F.get(k["chars"], start) - 1
                tokens = F.ceil(size / F.lit(chars)) if counts is None else F.get(k["tokens"], end) - F.get(k["tokens"], start)
                return (size <= max_chars) & (tokens <= max_tokens)

            def step(state: Column, i: Column) -> tuple[Column, Column]:
                start = state["start"]
                value = ~F.coalesce(F.get(k["label"], i), F.lit(True))
                before, alone = F.coalesce(F.get(k["label"], i - 1), F.lit(False)), i - start == 1
                to = lambda at, *out: F.struct(at.cast("int").alias("start"), ints(*out).alias("out"))
                moved = (
                    F.when(value & before & alone, to(i + 1, i + 1))  # a lone label takes its value
                    # A label goes with its value; if both are too long, they are a run of their own.
                    .when(value & before & ~fits(i - 1, i + 1), to(i + 1, i - 1, i + 1))
                    .when(value & before, to(i - 1, i - 1))
                    .otherwise(to(i, i))
                )
                made = F.when((i <= start) | fits(start, i + 1), to(start)).otherwise(moved)
                return F.struct(made["start"].alias("start")).cast(kind), made["out"]

            zero = F.struct(F.lit(0).alias("start")).cast(kind)
            ends = emitted(n, zero, step, kind)["out"]
            return let(ends, lambda e: cut(lines, F.when(F.coalesce(F.try_element_at(e, F.lit(-1)), F.lit(0)) < n, F.concat(e, ints(n))).otherwise(e), "\n"))

        return F.when(n > 0, let(known, cuts)).otherwise(_empty())

    return let(lines, of)


def split_table(text: Column, max_chars: Column, max_tokens: Column | None, chars: int = 4, counts: Column | None = None) -> Column:
    lines = F.filter(split_lines(text), lambda x: strip(x) != "")
    if max_tokens is None:  # the character cap alone
        short = F.when(F.size(lines) > 0, F.array(text)).otherwise(_empty())
        return F.when(F.length(text) <= max_chars, short).otherwise(
            pack_lines(lines, max_chars, count_tokens(text, chars), chars)
        )
    return pack_lines(lines, max_chars, max_tokens, chars, counts)


def _groups(sizes: Column, target: Column, most: Column) -> Column:
    """Where runs end that stop before passing ``most`` tokens or on reaching ``target``."""
    kind = "struct<tokens:int>"

    def step(state: Column, i: Column) -> tuple[Column, Column]:
        n = F.get(sizes, i)
        over = (state["tokens"] > 0) & (state["tokens"] + n > most)
        base = F.when(over, n).otherwise(state["tokens"] + n)
        full = base >= target
        out = F.when(over & full, ints(i, i + 1)).when(over, ints(i)).when(full, ints(i + 1)).otherwise(ints())
        return F.struct(F.when(full, 0).otherwise(base).cast("int").alias("tokens")).cast(kind), out

    n = F.size(sizes)
    ends = emitted(n, F.struct(F.lit(0).alias("tokens")).cast(kind), step, kind)["out"]
    return let(ends, lambda e: F.when(F.coalesce(F.try_element_at(e, F.lit(-1)), F.lit(0)) < n, F.concat(e, ints(n))).otherwise(e))


def greedy_group(pieces: Column, target: Column, most: Column, joiner: str, chars: int = 4) -> Column:
    """Runs that end before passing ``most`` tokens or on reaching ``target``, joined.
    Empty pieces are not expected."""
    return let(
        pieces,
        lambda p: F.when(F.size(p) > 0, let(let(_sizes(p, None, chars), lambda z: _groups(z, target, most)), lambda e: cut(p, e, joiner))).otherwise(_empty()),
    )


def _runs(text: Column, target: Column, most: Column, chars: int, counts: Column | None) -> Column:
    """The normalised text, whole or as runs of words: array<struct<text, tokens>>, with the
    counts of each run's words (null if they are estimated)."""
    kind, none = RUN, F.array().cast(f"array<{RUN}>")

    def of(t: Column) -> Column:
        size = count_tokens(t, chars) if counts is None else _total(counts)
        whole = F.array(F.struct(t.alias("text"), (F.lit(None) if counts is None else counts).cast(INTS).alias("tokens")).cast(kind))

        def words(w: Column) -> Column:
            sizes = F.transform(w, lambda x: count_tokens(x, chars)) if counts is None else counts

            def joined(ends: Column) -> Column:
                def run(end: Column, k: Column) -> Column:
                    start = F.when(k == 0, 0).otherwise(F.get(ends, k - 1))
                    own = F.lit(None) if counts is None else F.slice(counts, start + 1, end - start)
                    return F.struct(F.array_join(F.slice(w, start + 1, end - start), " ").alias("text"), own.cast(INTS).alias("tokens")).cast(kind)

                return F.transform(ends, run)

            return let(let(sizes, lambda z: _groups(z, target, most)), joined)

        return F.when(t == "", none).when(size <= most, whole).otherwise(let(F.split(t, " ", -1), words))

    return let(normalize_ws(text), of)


def split_prose(text: Column, target: Column, most: Column, chars: int = 4) -> Column:
    """The normalised text, whole or as runs of words."""
    return F.transform(_runs(text, target, most, chars, None), lambda r: r["text"])


def sliding_windows(text: Column, target: Column, overlap: int, chars: int = 4, counts: Column | None = None) -> Column:
    """Windows of whole sentences; each begins with the last sentences of the one
    before, as many as fit the overlap."""
    kind = "struct<start:int>"

    def of(sentences: Column) -> Column:
        n = F.size(sentences)

        def windows(upto: Column) -> Column:
            held = lambda a, b: F.get(upto, b) - F.get(upto, a)

            def step(state: Column, i: Column) -> tuple[Column, Column]:
                start = state["start"]
                over = (i > start) & (held(start, i + 1) > target)
                carried = F.array_min(F.filter(F.sequence(start, i), lambda k: held(k, i) <= overlap))
                now = F.when(over, carried).otherwise(start)
                return F.struct(now.cast("int").alias("start")).cast(kind), F.when(over, ints(start, i)).otherwise(ints())

            def texts(done: Column) -> Column:
                at = F.concat(done["out"], F.when(done["state"]["start"] < n, ints(done["state"]["start"], n)).otherwise(ints()))
                pairs = lambda a: F.transform(
                    F.sequence(F.lit(0), (F.size(a) / 2).cast("int") - 1),
                    lambda k: F.array_join(F.slice(sentences, F.get(a, 2 * k) + 1, F.get(a, 2 * k + 1) - F.get(a, 2 * k)), " "),
                )
                made = let(at, lambda a: F.when(F.size(a) > 0, pairs(a)).otherwise(_empty()))
                again = lambda w: (F.size(w) > 1) & (F.try_element_at(w, F.lit(-1)) == F.get(w, F.size(w) - 2))
                return let(made, lambda w: F.when(again(w), F.slice(w, 1, F.size(w) - 1)).otherwise(w))

            zero = F.struct(F.lit(0).alias("start")).cast(kind)
            return let(emitted(n, zero, step, kind), texts)

        return F.when(n > 0, let(running(_sizes(sentences, counts, chars)), windows)).otherwise(_empty())

    return let(normalize_ws(text), lambda t: F.when(t == "", _empty()).otherwise(let(split_sentences(t), of)))


def pieces(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with ``pieces``: array of section, order, is_table and raw text.

    With a tokenizer in the settings, two passes of Arrow batches count the words of sections
    and of headers; the folds take these counts in place of the estimate."""
    exact = s.tokens_are_exact
    rows = docs
    if exact:
        rows = counted(rows, F.transform("sections", lambda x: _words(x["text"])), "_counts", s)
    rows = rows.withColumn("_merged", merge_small_sections(F.col("sections"), s, F.col("_counts") if exact else None))
    header = lambda sec: context_header(F.col("scheme_name"), F.col("category"), F.col("plan"), sec["section_title"])
    if exact:
        rows = counted(rows.drop("_counts"), F.transform("_merged", lambda x: _words(header(x))), "_heads", s)
    else:
        rows = rows.withColumn("_heads", F.lit(None).cast("array<array<int>>"))

    def most(sec: Column, i: Column) -> Column:
        if exact:
            return F.greatest(F.lit(1), F.lit(s.chunk_max_tokens) - _total(F.get("_heads", i)) - 1)
        return body_budget(header(sec), s.chunk_max_tokens)

    # Each step goes over the array of the step before, so that none is computed twice.
    rows = rows.withColumn("_sized", F.transform("_merged", lambda sec, i: F.struct(sec.alias("sec"), most(sec, i).alias("most")))).drop("_merged", "_heads")

    def runs(x: Column) -> Column:
        sec, counts = x["sec"], x["sec"]["tokens"] if exact else None
        target = F.least(F.lit(s.chunk_target_tokens), x["most"])
        table = F.transform(
            split_table(sec["text"], F.lit(s.max_table_chars), x["most"], s.chars_per_token, counts),
            lambda t: F.struct(t.alias("text"), F.lit(None).cast(INTS).alias("tokens")).cast(RUN),
        )
        prose = _runs(sec["text"], target, x["most"], s.chars_per_token, counts)
        return F.struct(
            sec["section_title"].alias("section"), sec["order"].alias("order"), sec["is_table"].alias("is_table"), target.alias("target"),
            F.when(sec["is_table"], table).otherwise(prose).alias("runs"),
        )

    rows = rows.withColumn("_runs", F.transform("_sized", runs)).drop("_sized")

    def bodies(x: Column) -> Column:
        window = lambda r: sliding_windows(r["text"], x["target"], s.chunk_overlap_tokens, s.chars_per_token, r["tokens"] if exact else None)
        texts = F.flatten(F.transform(x["runs"], lambda r: F.when(x["is_table"], F.array(r["text"])).otherwise(window(r))))
        return F.transform(
            texts,
            lambda p: F.struct(
                x["section"].alias("section"), x["order"].alias("order"), x["is_table"].alias("is_table"), normalize_lines(p).alias("body")
            ),
        )

    rows = rows.withColumn("_all", F.flatten(F.transform("_runs", bodies))).drop("_runs")
    return rows.withColumn("pieces", dedupe_pieces(F.col("_all"))).drop("_all")


def dedupe_pieces(all_: Column) -> Column:
    """Prose that an earlier piece of the document already has goes; tables stay."""

    def of(every: Column) -> Column:
        marked = F.transform(every, lambda p, i: F.struct(p["is_table"].alias("table"), p["body"].alias("body"), i.alias("i")))

        def kept(m: Column) -> Column:  # in order of kind, body and place: a repeat stands behind its first
            new = lambda x, k: x["table"] | (k == 0) | F.get(m, k - 1)["table"] | (F.get(m, k - 1)["body"] != x["body"])
            first = F.filter(F.transform(m, lambda x, k: F.when(F.coalesce(new(x, k), F.lit(True)), x["i"])), lambda i: i.isNotNull())
            return F.transform(F.sort_array(first), lambda i: F.get(every, i))

        return let(F.sort_array(marked), kept)

    return let(all_, of)


def chunk_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per chunk, numbered from 0 within its document."""
    return number_pieces(pieces(docs, s))


def number_pieces(docs: DataFrame) -> DataFrame:
    """Chunks from documents with ``pieces``."""
    # Outer, then filtered: for a plain explode the optimiser would put a test of the
    # array's size below, with a second copy of the expressions that make it.
    rows = docs.select(
        "scheme_id", "scheme_name", "category", "plan", "source_url", "fetched_at",
        F.posexplode_outer("pieces").alias("chunk_index", "p"),
    ).where("p IS NOT NULL")
    header = context_header(F.col("scheme_name"), F.col("category"), F.col("plan"), F.col("p.section"))
    key = F.concat_ws("|", "source_url", F.col("p.order").cast("string"), F.col("chunk_index").cast("string"), "p.body")
    return rows.select(
        F.substring(F.sha2(key, 256), 1, 16).alias("chunk_id"),
        "scheme_id", "scheme_name", "category", "plan",
        F.col("p.section").alias("section"),
        "source_url", "fetched_at", "chunk_index",
        F.col("p.is_table").alias("is_table"),
        F.sha2("p.body", 256).alias("content_sha256"),
        F.concat(header, F.lit("\n"), F.col("p.body")).alias("embed_text"),
        F.col("p.body").alias("display_text"),
    )


REQUIRED = (
    "chunk_id", "scheme_id", "scheme_name", "category", "plan", "section", "source_url", "fetched_at", "content_sha256",
    "embed_text", "display_text",
)


def violations(chunks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """chunk_id and violation: reported, not raised."""
    tests = [
        F.when(F.col("_tokens") > s.chunk_max_tokens, "over_limit"),
        F.when(~F.startswith("embed_text", F.lit(MARK)), "no_header"),
        F.when(F.contains("display_text", F.lit(MARK)), "header_leak"),
        *(F.when(F.coalesce(strip(F.col(c)), F.lit("")) == "", F.lit(f"empty_{c}")) for c in REQUIRED),
    ]
    found = F.filter(F.array(*tests), lambda v: v.isNotNull())
    return sized(chunks, "embed_text", "_tokens", s).select("chunk_id", F.explode(found).alias("violation"))


def chunk_report(chunks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Chunks, tables and token sizes of each scheme."""
    return sized(chunks.select("scheme_id", "is_table", "embed_text"), "embed_text", "n", s).groupBy("scheme_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if("is_table").alias("n_tables"),
        F.min("n").alias("min_tokens"),
        F.max("n").alias("max_tokens"),
        F.floor(F.sum("n") / F.count(F.lit(1))).cast("bigint").alias("mean_tokens"),
    )
