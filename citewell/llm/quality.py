"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one failure bit per rule; policies are versioned masks over those bits, so a new
policy or an ablation reads the ledger and never the texts again.

Defined results: a null text counts as empty (no words, fails ``short``); repeated
rows each get their own ledger row; columns of the input whose names clash with
the ledger's are replaced, other columns are kept only if asked for by ``keep``; a
text of any length is measured whole; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.llm.common import documents, whole, words

#: Symbols that ordinary prose rarely has.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 5

#: Name, bit and failure condition of each rule, as SQL over the measurements.
#: Percentages are compared as integers, so every engine decides alike.
RULES = (
    ("short", 0, "n_words < 10"),
    ("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    ("symbols", 2, "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", 3, "100 * n_dup_lines > 60 * n_lines"),
    ("word_length", 4, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("shouting", 5, "100 * n_upper > 50 * word_chars AND n_words >= 10"),
    ("exclaiming", 6, "100 * n_exclaim > 50 * n_words"),
)
BASE_RULES = ("short", "repeated_words")


def mask(*names: str) -> int:
    bits = {name: bit for name, bit, _ in RULES}
    return sum(1 << bits[n] for n in names)


@dataclass(frozen=True)
class Policy:
    """A document passes if none of the rules in ``rules`` failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask(*self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE_RULES),
        Policy("v1", tuple(name for name, _, _ in RULES)),
    )
}
DEFAULT_POLICY = "v1"


def _repeat_words(hashes: Column, ranked: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more.

    ``ranked`` is null where no hash repeats, else the (hash, position) pairs in
    order, so a repeat is a neighbour. A window at x newly covers
    min(5, x - previous) words.
    """
    repeated = F.filter(
        F.transform(
            ranked,
            lambda x, k: F.when(
                (x["h"] == F.get(ranked, k - 1)["h"]) | (x["h"] == F.get(ranked, k + 1)["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    zero = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        F.sort_array(repeated),
        zero,
        lambda acc, x: F.struct(
            x.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["at"])).cast("bigint").alias("n")
        ),
        lambda acc: acc["n"],
    )
    return F.when(ranked.isNull(), F.lit(0).cast("bigint")).otherwise(covered)


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and the measurements, in one pass without a shuffle."""
    clean = list(keep)
    t = F.col("_t")
    stage = docs.select(*clean, whole(text).alias("_t"))
    stage = stage.select(*clean, "_t", words(t).alias("_w"))
    n = F.size("_w")
    window = lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(WINDOW)))
    stage = stage.select(
        *clean,
        "_t",
        n.cast("bigint").alias("n_words"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).alias("_h"),
    )
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stage = stage.select(
        *clean,
        "n_words",
        F.length(F.translate(t, WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("bigint").alias("n_exclaim"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("bigint").alias("n_upper"),
        lines.alias("_l"),
        F.col("_h"),
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_r"),
    )
    return stage.select(
        *clean,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_h"), F.col("_r")).alias("n_repeat_words"),
        F.size("_l").cast("bigint").alias("n_lines"),
        "n_exclaim",
        "n_upper",
    )


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The measurements with ``fail_bits``: bit k is set where rule k fails."""
    bits = " + ".join(f"CASE WHEN {test} THEN {1 << bit}L ELSE 0L END" for _, bit, test in RULES)
    return measure(docs, keep, text).withColumn("fail_bits", F.expr(bits))


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def apply_policy(book: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    return book.withColumn("policy", F.lit(version)).withColumn("kept", passes(POLICIES[version]))


def ablation(book: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """One row per rule of the policy: documents failing it, documents only it
    rejects, and documents kept with and without it.

    The corpus is first aggregated to one row per failure pattern (at most two to
    the number of rules), so the rules are crossed with patterns, not documents.
    """
    policy = POLICIES[version]
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("bigint"))
    patterns = book.groupBy(failed.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(
        *(F.struct(F.lit(n).alias("rule"), F.lit(1 << b).cast("bigint").alias("bit")) for n, b, _ in RULES if n in policy.rules)
    )
    hit = F.col("pattern").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("pattern") == F.col("r.bit")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return (
        patterns.select("pattern", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            some(hit).alias("n_failing"),
            some(only).alias("n_only"),
            some(F.col("pattern") == 0).alias("n_kept"),
            some((F.col("pattern") == 0) | only).alias("n_kept_without"),
        )
    )


def filter_documents(docs: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """The rows that the policy keeps, with the input's columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    book = ledger(docs.select(row, F.col("text").alias("_text")), ("_row",), "_text")
    # The number keeps the filter above the measurements: pushed below them, it
    # would be a copy of all their expressions, computed anew in every lambda.
    book = book.withColumn("_number", F.monotonically_increasing_id())
    return book.where(passes(POLICIES[version]) & (F.col("_number") >= 0)).select("_row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(documents(spark, sf_dir)))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(*BASE_RULES)).cast("bigint")) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits",
    )


#: Rules, bits and policies are written here anew, from what they say and not from the code.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, list_slice(ws, i, i + 4) AS g FROM w, unnest(range(1, len(ws) - 3)) AS r(i)
), c AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM c, range(0, 5) AS o(k) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim,
    length(regexp_replace(t, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN covered USING (rid)
), f AS (
  SELECT *,
    n_words < 10 AS few_words,
    n_repeat_words / n_words > 0.2 AS repeats_itself,
    n_symbols / n_words > 0.3 AS symbols,
    n_dup_lines / n_lines > 0.6 AS same_lines,
    n_words > 0 AND (word_chars / n_words < 2 OR word_chars / n_words > 20) AS odd_words,
    n_words >= 10 AND n_upper / word_chars > 0.5 AS capitals,
    n_exclaim / n_words > 0.5 AS exclaims
  FROM m
), b AS (
  SELECT *, (CASE WHEN few_words THEN 1 ELSE 0 END + CASE WHEN repeats_itself THEN 2 ELSE 0 END + CASE WHEN symbols THEN 4 ELSE 0 END
    + CASE WHEN same_lines THEN 8 ELSE 0 END + CASE WHEN odd_words THEN 16 ELSE 0 END + CASE WHEN capitals THEN 32 ELSE 0 END
    + CASE WHEN exclaims THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       few_words OR coalesce(repeats_itself, false) AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
