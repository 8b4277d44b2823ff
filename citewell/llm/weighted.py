"""Document fingerprints by consistent weighted sampling.

A document is a set of terms (its words) with weights (their counts). For each of
``SAMPLES`` samples a term has, by the hash of the term and the sample's number, r and c
from Gamma(2, 1) and b uniform in [0, 1). With weight S it stands at t = floor(ln S / r + b)
and has the value a = c exp(-r (t - b + 1)); the sample of the document is (term, t) of
the least a. Two documents agree in a sample with a probability of their generalised
Jaccard similarity, the sum of the lesser weights over that of the greater ones, so the share
of equal samples estimates it.

r is read from ``CELLS`` quantiles of the distribution. c must keep its tail, since the least
of many counts: it is the root of a uniform number, which is what the distribution
looks like near zero, times a factor by quantile.

Everything is an expression of the JVM. Hashes of words are sorted inside a row, runs of equal
hashes are terms, and terms become rows of ``BLOCK`` samples, small enough for one
compiled method; their minima are taken where the rows are, without a shuffle. Two texts of
a row share the draws of their common terms.

Defined results: a null text is empty, and a text without words has one empty term; equal
texts have equal fingerprints; repeated rows (doc_id and text) are one document and get
its result each; documents follow one another by doc_id, null last, of equal doc_ids by a
hash of id and text; an only document follows itself; a text of any length counts whole;
an empty table gives an empty result; only doc_id and text are read, so further columns
may have any names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.llm.common import documents, whole, words
from citewell.operators.durable import durable
from citewell.operators.ordinals import numbered

SAMPLES, BLOCK = 32, 4
CELLS = 1024
#: An odd constant whose multiples tell the samples of a block apart.
STEP = 0x5851F42D4C957F2D
#: Of a value times the document's weight, what fits 31 bits: the least exceeds 64 with
#: a probability of exp(-64).
SCALE = 2.0**25
MOST = 2.0**31 - 1
KEY = ("k1", "k2")


def gamma_quantile(u: float) -> float:
    """Where 1 - (1 + x) exp(-x), the distribution of Gamma(2, 1), reaches u."""
    x = math.sqrt(2 * u) if u < 0.5 else 2 - math.log(1 - u)
    for _ in range(60):
        x = max(x - (1 - (1 + x) * math.exp(-x) - u) / (x * math.exp(-x)), x / 2)
    return x


def _tables() -> tuple[Column, Column]:
    """r, and c over the root, by cell."""
    at = [(i + 0.5) / CELLS for i in range(CELLS)]
    array = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<double>")
    return array([gamma_quantile(u) for u in at]), array([gamma_quantile(u) / math.sqrt(u) for u in at])


def _terms(rows: DataFrame, keep: tuple[str, ...], texts: tuple[str, ...]) -> DataFrame:
    """``keep``, term and, for each of one or two texts, the term's weight n0, n1 (0: absent)
    and the text's whole weight w0, w1."""
    listed = lambda t: F.when(F.regexp_like(t, F.lit(r"[^\x20\x09-\x0D]")), words(F.col(t))).otherwise(F.array(F.lit("")))
    rows = rows.select(*keep, *(listed(t).alias(f"l{k}") for k, t in enumerate(texts)))
    low = F.lit(-2).cast("bigint")
    tagged = lambda k: F.transform(f"l{k}", lambda w: F.xxhash64(w).bitwiseAND(low).bitwiseOR(F.lit(k).cast("bigint")))
    totals = [F.size(f"l{k}").cast("double").alias(f"w{k}") for k in range(len(texts))]
    rows = rows.select(*keep, *totals, F.sort_array(F.concat(*(tagged(k) for k in range(len(texts))))).alias("s"))
    first = lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1))
    rows = rows.select("*", F.filter(F.sequence(F.lit(0), F.size("s") - 1), first).alias("f"))
    to = lambda k: F.coalesce(F.get("f", k), F.size("s"))
    run = F.transform(
        "f",
        lambda p, k: F.struct(
            F.get("s", p).alias("v"), (to(k + 1) - p).alias("n"), F.get("s", p - 1).alias("before"),
            F.get("s", to(k + 1)).alias("after"), (to(k + 2) - to(k + 1)).alias("m"),
        ),
    )
    names = [f"w{k}" for k in range(len(texts))]
    rows = rows.select(*keep, *names, F.explode(run).alias("x")).select(*keep, *names, "x.*")
    term = lambda c: F.shiftright(c, 1)
    rows = rows.where(F.col("before").isNull() | (term("before") != term("v")))
    second = F.col("v").bitwiseAND(F.lit(1).cast("bigint")) == 1
    both = F.coalesce(term("after") == term("v"), F.lit(False))
    n0 = F.when(second, 0).otherwise(F.col("n"))
    n1 = F.when(second, F.col("n")).when(both, F.col("m")).otherwise(0)
    return rows.select(*keep, *names, term("v").alias("term"), n0.alias("n0"), n1.alias("n1"))


def signatures(rows: DataFrame, keys: tuple[str, ...], texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """``keys`` and, for each of one or two text columns, its fingerprint s0, s1: 8 hex digits
    a sample. ``keys`` tell the rows apart. Rows that are dealt by some of them are
    not shuffled again."""
    r_of, c_of = _tables()
    m32, cell = F.lit((1 << 32) - 1).cast("bigint"), F.lit(CELLS - 1).cast("bigint")
    every, versions = range(BLOCK), range(len(texts))
    bits = CELLS.bit_length() - 1
    of = lambda name, k: F.col(f"{name}{k}")
    drawn = _terms(rows, keys, texts).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // BLOCK - 1))))
    # ln of 0 is null, and so is all that follows from it: the minimum leaves it out.
    keep = [*keys, "block", *(f"ln{v}" for v in versions), *(f"scale{v}" for v in versions)]
    drawn = drawn.select(
        *keys, "block", F.xxhash64("term", "block").alias("h"), *(F.ln(of("n", v)).alias(f"ln{v}") for v in versions),
        *((of("w", v) * F.lit(SCALE)).alias(f"scale{v}") for v in versions),
    )
    # Step by step, so that what is used twice is computed once.
    salt = lambda k: F.lit((k + 1) * STEP % (1 << 63)).cast("bigint")
    drawn = drawn.select(*keep, *(F.xxhash64(F.col("h").bitwiseXOR(salt(k))).alias(f"x{k}") for k in every))
    drawn = drawn.select(
        *keep, *(f"x{k}" for k in every), *(F.xxhash64(of("x", k)).alias(f"y{k}") for k in every),
        *(F.get(r_of, of("x", k).bitwiseAND(cell).cast("int")).alias(f"r{k}") for k in every),
        *((F.shiftrightunsigned(of("x", k), bits).cast("double") * F.lit(2.0 ** (bits - 64))).alias(f"b{k}") for k in every),
    )
    root = lambda y: F.sqrt((F.shiftrightunsigned(y, 11).cast("double") + 0.5) * F.lit(2.0**-53))
    drawn = drawn.select(
        *keep, *(f"{n}{k}" for n in "xrb" for k in every),
        *((root(of("y", k)) * F.get(c_of, F.shiftrightunsigned(of("y", k), 64 - bits).cast("int"))).alias(f"c{k}") for k in every),
        *(F.floor(F.col(f"ln{v}") / of("r", k) + of("b", k)).alias(f"t{v}_{k}") for v in versions for k in every),
    )

    def packed(v: int, k: int) -> Column:
        """The value's 31 bits before 32 bits of (term, t): the least has both."""
        t = F.col(f"t{v}_{k}")
        a = of("c", k) * F.exp(-of("r", k) * (t.cast("double") - of("b", k) + 1.0))
        code = F.floor(F.least(a * F.col(f"scale{v}"), F.lit(MOST)))
        return F.shiftleft(code, 32).bitwiseOR(F.xxhash64(of("x", k).bitwiseXOR(t)).bitwiseAND(m32))

    least = drawn.groupBy(*keys, "block").agg(*(F.min(packed(v, k)).alias(f"m{v}_{k}") for v in versions for k in every))
    digits = lambda c: F.lpad(F.hex(F.col(c).bitwiseAND(m32)), 8, "0")
    blocks = least.select(*keys, "block", *(F.lower(F.concat(*(digits(f"m{v}_{k}") for k in every))).alias(f"s{v}") for v in versions))
    whole_ = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", *(f"s{v}" for v in versions)))).alias("all"))
    return whole_.select(*keys, *(F.array_join(F.col(f"all.s{v}"), "").alias(f"s{v}") for v in versions))


def likeness(a: str | Column, b: str | Column) -> Column:
    """The share of equal samples of two fingerprints."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    part = lambda s, k: F.substring(s, 8 * k + 1, 8)
    return sum(F.when(part(a, k) == part(b, k), 1).otherwise(0) for k in range(SAMPLES)).cast("double") / SAMPLES


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    row = docs.select("doc_id", whole("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    return signatures(row, ("row", "doc_id")).select("doc_id", F.col("s0").alias("fingerprint"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of both, which stand for the document."""
    text = whole("text")
    both = lambda salt: F.xxhash64(F.lit(salt), F.col("doc_id").isNull(), "doc_id", text)
    return docs.select("doc_id", text.alias("text"), both(1).alias("k1"), both(2).alias("k2"))


def followers(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, k1, k2, n_rows, n_chars, and f1, f2 of the one that follows."""
    each = keyed(docs).select(*KEY, "doc_id", F.length("text").cast("bigint").alias("n_chars"))
    each = each.groupBy(*KEY, "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("n_rows"))
    placed = numbered(each, F.col("doc_id").asc_nulls_last(), F.col("k1"), F.col("k2"), name="at")
    after = F.pmod(F.col("at") - 1, F.lit(max(placed.count(), 1)))
    following = placed.select(after.alias("_at"), F.col("k1").alias("f1"), F.col("k2").alias("f2"))
    joined = placed.join(following, F.col("at") == F.col("_at"))
    return durable(joined.select("doc_id", *KEY, "n_rows", "n_chars", "f1", "f2"), "weighted-followers")


def edited_documents(docs: DataFrame, pairs: DataFrame, part: int = 4) -> DataFrame:
    """k1, k2, text and edited: the last of ``part`` parts of the code points replaced by as
    many of the following document's first, or all it has. Texts are dealt by key
    once; only beginnings are moved to the document before."""
    texts = keyed(docs).groupBy(*KEY).agg(F.max("text").alias("text"))
    cut = F.floor(F.col("n_chars") / part).cast("int")
    wanted = pairs.select(F.col("f1").alias("_1"), F.col("f2").alias("_2"), F.col("k1").alias("to1"), F.col("k2").alias("to2"), cut.alias("cut"))
    start = texts.join(wanted, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")))
    start = start.select("to1", "to2", "cut", F.substring("text", F.lit(1), F.col("cut")).alias("start"))
    rows = texts.join(start, (F.col("k1") == F.col("to1")) & (F.col("k2") == F.col("to2")))
    kept = F.substring("text", F.lit(1), F.length("text") - F.col("cut"))
    return rows.select(*KEY, "text", F.concat(kept, F.col("start")).alias("edited"))


def op11_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    pairs = followers(docs)
    rows = edited_documents(docs, pairs).withColumn("edited_sha256", F.sha2("edited", 256))
    found = signatures(rows, (*KEY, "edited_sha256"), ("text", "edited"))
    found = durable(found, "weighted-signatures")
    one = found.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "edited_sha256", F.col("s0").alias("fingerprint"), F.col("s1").alias("edited_fingerprint"))
    after = found.select(F.col("k1").alias("_f1"), F.col("k2").alias("_f2"), F.col("s0").alias("next"))
    joined = pairs.join(one, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")))
    joined = joined.join(after, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")))
    out = joined.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next").alias("near_next"), "n_rows",
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_rows"))).drop("_copy", "n_rows")
