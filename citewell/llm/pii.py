"""Personal data by bootstrapped contextual extraction.

Base matches (email, ip, card, phone) are the seeds. The words around them are
lexical patterns; patterns and the identifiers they surround form a graph over the
whole corpus. Rounds of joins score patterns by the share of their instances that
are of one kind, and instances by the patterns they stand in, until the scores
settle. Instances found in one round support patterns in the next, so a pattern may
be learned from found instances alone. Patterns of high confidence and enough
distinct instances then find identifiers that no base pattern describes, wherever
they stand.

An identifier is a token of 6 or more characters with at least 3 digits. Patterns are
the two words before it, the two after it, the one on either side together, and a
label before it (a word that ends in ``:``, ``=`` or ``#``).

Defined results: a null text is empty; repeated rows each get their own result and
count once in the graph, since it holds distinct instances; found spans never
overlap base spans; a text of any length is scanned whole, and words and identifiers
of any length take part; an empty table gives an empty result; only doc_id and the
text are read, so further columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.llm.common import discard, documents, durable, whole
from citewell.llm.spans import found, listed, number_of, placed

#: The kinds in their order, with their patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
KINDS = tuple(PATTERNS)
#: A whole word that holds a digit.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
SHORTEST, DIGITS = 6, 3
#: Words taken on either side.
NEAR = 2

#: Distinct instances of a kind that a pattern needs, and its least confidence.
SUPPORT = 5
CONFIDENCE = 0.8
#: The score from which an instance counts as one of a kind.
SURE = 0.7
#: Scores that change by less have settled.
SETTLED = 0.01
#: What an instance passes on of the score of the patterns it stands in.
DAMPING = 0.9

OCCURRENCE = "array<struct<pattern:string,instance:string,kind:string,start:bigint,end:bigint>>"


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        value = lambda p: F.concat(F.lit("0"), F.call_function("right", p, F.lit(3))).cast("int")
        return F.forall(F.split(v, r"\."), lambda p: small(p) & (value(p) <= 255))
    if kind == "card":
        # Every second digit from the right counts double, less nine over nine.
        return (
            F.aggregate(
                F.split(F.reverse(digits), ""),
                F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
                lambda acc, d: F.struct(
                    (acc["i"] + 1).alias("i"),
                    (
                        acc["sum"]
                        + F.when(acc["i"] % 2 == 0, d.try_cast("int")).otherwise(
                            d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)
                        )
                    ).alias("sum"),
                ),
                lambda acc: acc["sum"] % 10,
            )
            == 0
        )
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _valid_spans(kind: str) -> Column:
    return F.filter(F.col(f"{kind}_spans"), lambda s: _valid(kind, s["value"]))


def _of_kind(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def contexts(left: Column, right: Column) -> Column:
    """The patterns around an identifier, from the words before it (nearest first) and
    after it: ``<a b`` and ``>a b`` for two words on a side, ``|a b`` for one on each,
    ``=a`` for a label."""
    clean = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}:=#]+", "")
    one, two, after, further = (clean(F.get(side, F.lit(k))) for side, k in ((left, 0), (left, 1), (right, 0), (right, 1)))
    said = lambda *words: reduce(lambda x, y: x & y, [F.coalesce(w != "", F.lit(False)) for w in words])
    both = F.array(
        F.when(said(one, two), F.concat(F.lit("<"), two, F.lit(" "), one)),
        F.when(said(after, further), F.concat(F.lit(">"), after, F.lit(" "), further)),
        F.when(said(one, after), F.concat(F.lit("|"), one, F.lit(" "), after)),
        F.when(one.rlike(r"\p{L}.*[:=#]$"), F.concat(F.lit("="), one)),
    )
    return F.filter(both, lambda p: p.isNotNull())


def _occurrences(spans: Column, kind: Column, instance) -> Column:
    """One entry for each span and pattern it stands in."""

    def of(s: Column) -> Column:
        return F.transform(
            contexts(s["left"], s["right"]),
            lambda p: F.struct(
                p.alias("pattern"), instance(s).alias("instance"), kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end")
            ),
        )

    return F.flatten(F.transform(spans, of)).cast(OCCURRENCE)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """row_id, doc_id, base (spans by kind and start) and occurrences of seeds and
    other identifiers in patterns: all that later steps need, in one pass."""
    t = F.col("_t")
    every = PATTERNS | {"token": TOKEN}
    stage = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", whole(text).alias("_t"))
    stage = stage.select("*", *(found(t, p).alias(f"_{k}") for k, p in every.items()))
    stage = stage.select("row_id", "doc_id", *(placed(t, F.col(f"_{k}"), p, NEAR).alias(f"{k}_spans") for k, p in every.items()))
    valid = {k: _valid_spans(k) for k in KINDS}
    stage = stage.select("row_id", "doc_id", "token_spans", *(v.alias(k) for k, v in valid.items()))
    base = F.concat(*(_of_kind(k) for k in KINDS))
    stage = stage.withColumn("base", base)
    core = F.transform("token_spans", _core)
    free = F.filter(
        core,
        lambda s: (F.length(s["value"]) >= SHORTEST)
        & (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= DIGITS)
        & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    seeds = (_occurrences(F.col(k), F.lit(k), lambda s: F.sha2(s["value"], 256)) for k in KINDS)
    others = _occurrences(free, F.lit(None).cast("string"), lambda s: F.sha2(s["value"], 256))
    return stage.select("row_id", "doc_id", "base", F.concat(*seeds, others).alias("occurrences"))


def _core(s: Column) -> Column:
    """A token without the punctuation at its ends."""
    lead = F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^[^A-Za-z0-9+]++", ""))
    value = F.regexp_replace(s["value"], r"^[^A-Za-z0-9+]++|(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
    start = s["start"] + lead
    return F.struct(
        start.cast("bigint").alias("start"),
        (start + F.length(value)).cast("bigint").alias("end"),
        value.alias("value"),
        s["left"].alias("left"),
        s["right"].alias("right"),
    )


def graph(scanned: DataFrame, support: int = SUPPORT) -> DataFrame:
    """pattern, instance, kind (of a seed, else null): distinct edges, of patterns
    with enough distinct instances."""
    edges = (
        scanned.where(F.size("occurrences") > 0)
        .select(F.explode("occurrences").alias("o"))
        .groupBy(F.col("o.pattern").alias("pattern"), F.col("o.instance").alias("instance"))
        .agg(F.max("o.kind").alias("kind"))
    )
    edges = durable(edges, "pii-edges")
    rich = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= support)
    kept = durable(edges.join(rich, "pattern"), "pii-graph")
    discard(edges)
    return kept


def patterns(edges: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pattern, kind, sure (instances surely of that kind) and confidence of the trusted
    patterns, after rounds of scoring patterns by their instances and instances by
    their patterns. Only trusted patterns pass scores on: those under ``confidence``
    cannot lift one another above it.

    The rounds end by themselves. They start from seeds alone, and a round's scores are
    sums over those of the round before, so from round to round no pattern loses trust or
    confidence; each round but the last adds a pattern or lifts a confidence, of 1 at
    most, by ``SETTLED``."""
    seeds = edges.where("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    unknown = edges.where("kind IS NULL").select("pattern", "instance")
    scores, scored = seeds, None
    while True:
        sums = edges.select("pattern", "size", "instance").join(scores, "instance").groupBy("pattern", "size", "kind")
        sums = sums.agg(F.sum("score").alias("sum"), F.count_if(F.col("score") >= SURE).alias("sure"))
        now = sums.where(F.col("sure") >= support).select(
            "pattern", "kind", "sure", F.least(F.lit(1.0), F.col("sum") / F.col("size")).alias("confidence")
        )
        now = durable(now.where(F.col("confidence") >= confidence), "pii-patterns")
        changed = not now.isEmpty() if scored is None else _moved(scored, now)
        if scored is not None:
            discard(scored)
        scored = now
        if not changed:
            return scored
        # An instance is of a kind unless every pattern it stands in errs.
        errs = F.sum(F.log(1 - F.lit(DAMPING) * F.col("confidence")))
        found = unknown.join(scored, "pattern").groupBy("instance", "kind").agg((1 - F.exp(errs)).alias("score"))
        scores = seeds.unionByName(found)


def _moved(before: DataFrame, now: DataFrame) -> bool:
    """Whether a pattern came, went, or changed its confidence."""
    both = before.select("pattern", "kind", F.col("confidence").alias("was")).join(now, ["pattern", "kind"], "full_outer")
    apart = F.abs(F.coalesce("was", F.lit(-1.0)) - F.coalesce("confidence", F.lit(-1.0))) > SETTLED
    return not both.where(apart).isEmpty()


def personal_data(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, base and more (found spans), spans as structs of kind, start, end."""
    scanned = durable(scan(docs), "pii-scan")
    edges = graph(scanned)
    scored = patterns(edges)
    # Of several kinds a pattern could give, the likeliest.
    trusted = scored.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    trusted = durable(trusted.select("pattern", F.concat(F.lit("like_"), "best.kind").alias("like")), "pii-trusted")
    discard(edges)
    discard(scored)
    unknown = scanned.where(F.size("occurrences") > 0).select("row_id", F.explode("occurrences").alias("o"))
    unknown = unknown.where("o.kind IS NULL").select("row_id", "o.pattern", "o.start", "o.end")
    hits = unknown.join(trusted, "pattern")
    span = F.struct(F.col("like").alias("kind"), "start", "end")
    by_row = hits.groupBy(F.col("row_id").alias("_row")).agg(F.sort_array(F.collect_set(span)).alias("more"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return scanned.join(by_row, F.col("row_id") == F.col("_row"), "left").select(
        "row_id", "doc_id", "base", F.coalesce("more", none).alias("more")
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(documents(spark, sf_dir))
    base = F.col("base")
    return rows.select(
        "doc_id",
        *(number_of(base, k).alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat("base", "more")).alias("spans"),
    )
