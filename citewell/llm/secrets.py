"""Secret scan with corpus-wide ownership frequency.

Candidates are found by pattern in every whole text. Their hashes are aggregated
over the corpus by distinct repositories (different texts) and owners (sources):
a value that many owners have is a copied example, one that few have and that
looks random is live. Every value known as a live candidate is then looked for
among all bare tokens, so a secret pasted without its label is found as well.

Values and tokens are hashed in one form: without punctuation at their ends, as
words between runs with ``=`` or ``/``. A token also offers each run of its words
that has as many words as some live value, so a value glued to a name or path is
found at its place.

Defined results: a null text is empty; a null owner is one owner; repeated rows
count as one repository but each get their own result; overlapping spans of
different kinds all stay; a text of any length is scanned whole; an empty table gives
an empty result; only doc_id, the owner and the text are read (``redact_documents``
hands all columns on), so further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.llm.common import documents, durable, whole
from citewell.llm.spans import found, listed, number_of, placed

#: The kinds in their order, with their patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
KINDS = (*PATTERNS, "copy")
#: A bare token that may be a known value: 12 or more of a value's characters, a digit among them.
TOKEN = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])[A-Za-z0-9+/_.=-]{12,}+"
VALUE_CHARS = 12
#: Around a value or token, not part of it; and between its words, with what trims there.
FRONT, BACK = r"^[.=/+_-]++", r"(?<![.=/])[.=/]++$"
BETWEEN = r"(?<!\.)\.*+[=/][.=/+_-]*+"
#: Owners from which on a value counts as a copied example.
EXAMPLE_OWNERS = 3
#: Different characters that a live-looking value has at least.
LIVE_CHARS = 6

CANDIDATE = "array<struct<start:bigint,rank:int,kind:string,end:bigint,hash:string,words:int,live:boolean>>"
PIECE = "struct<start:bigint,end:bigint,low:bigint,high:bigint,hash:string,after:string,digit:boolean,letter:boolean>"


def _candidate(spans: Column, rank: int, value) -> Column:
    def one(s: Column) -> Column:
        v = value(s["value"])

        def of(parts: Column) -> Column:
            return F.struct(
                s["start"].alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(KINDS[rank]).alias("kind"),
                s["end"].alias("end"),
                hashed(parts).alias("hash"),
                F.size(parts).alias("words"),
                live_looking(v).alias("live"),
            )

        return F.transform(F.array(worded(v, F.lit(0))), of)

    return F.flatten(F.transform(spans, one))


def worded(value: Column, start: Column) -> Column:
    """The words of a value that starts at ``start``: their places, hashes and what
    follows each; from ``low`` to ``high`` with the punctuation around."""
    zero = F.struct(start.cast("bigint").alias("at"), F.array().cast(f"array<{PIECE}>").alias("out"))

    def of(x: Column) -> Column:
        texts, gaps = F.split(x["v"], BETWEEN, -1), F.regexp_extract_all(x["v"], F.lit(BETWEEN), F.lit(0))

        def step(acc: Column, w: Column) -> Column:
            first = F.size(acc["out"]) == 0
            begin = acc["at"] + F.when(first, x["front"]).otherwise(0)
            end = begin + F.length(w["text"])
            high = end + F.when(w["gap"].isNull(), x["back"]).otherwise(F.length(w["gap"]))
            low = F.when(first, acc["at"]).otherwise(begin - F.length(F.element_at(acc["out"], -1)["after"]))
            piece = F.struct(
                begin.alias("start"), end.alias("end"), low.alias("low"), high.alias("high"),
                F.sha2(w["text"], 256).alias("hash"), F.coalesce(w["gap"], F.lit("")).alias("after"),
                w["text"].rlike("[0-9]").alias("digit"), w["text"].rlike("[A-Za-z]").alias("letter"),
            )
            return F.struct(high.cast("bigint").alias("at"), F.concat(acc["out"], F.array(piece)).cast(f"array<{PIECE}>").alias("out"))

        # One-element arrays bind what is used often to a name.
        both = F.array(F.struct(texts.alias("texts"), gaps.alias("gaps")))
        zipped = F.flatten(
            F.transform(both, lambda b: F.transform(b["texts"], lambda t, i: F.struct(t.alias("text"), F.get(b["gaps"], i).alias("gap"))))
        )
        return F.aggregate(zipped, zero, step, lambda acc: acc["out"])

    def trimmed(v: Column) -> Column:
        cut = F.regexp_replace(v, FRONT, "")
        core = F.regexp_replace(cut, BACK, "")
        sides = ((F.length(v) - F.length(cut)).alias("front"), (F.length(cut) - F.length(core)).alias("back"))
        # Of punctuation alone: as it is, so that such values stay apart.
        return F.when(core == "", F.struct(v.alias("v"), F.lit(0).alias("front"), F.lit(0).alias("back"))).otherwise(F.struct(core.alias("v"), *sides))

    return F.flatten(F.transform(F.transform(F.array(value), trimmed), of))


def hashed(parts: Column) -> Column:
    """The hash of a run of words: of theirs, with what stands between them."""
    ahead = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(p["hash"], p["after"]))
    return F.sha2(F.concat(F.array_join(ahead, ""), F.element_at(parts, -1)["hash"]), 256)


def live_looking(value: Column) -> Column:
    """Digits and letters mixed, and enough different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARS)


def scan(docs: DataFrame, owner: str = "source", text: str = "text") -> DataFrame:
    """row_id, doc_id, owner, repo (hash of the text), base (an array of candidates)
    and tokens (an array of arrays of words), in one pass. Values leave it only as hashes."""
    t = F.col("_t")
    stage = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.col(owner).alias("owner"), whole(text).alias("_t")
    )
    stage = stage.select("*", *(found(t, p).alias(f"_{k}") for k, p in (PATTERNS | {"copy": TOKEN}).items()))
    places = {k: placed(t, F.col(f"_{k}"), p) for k, p in (PATTERNS | {"copy": TOKEN}).items()}
    same = lambda v: v
    group2 = lambda v: F.regexp_extract(v, ASSIGN_VALUE, 1)
    assign = F.filter(places["assign"], lambda s: F.length(group2(s["value"])) >= VALUE_CHARS)
    return stage.select(
        "row_id",
        "doc_id",
        "owner",
        F.when((F.size("_assign") > 0) | (F.size("_access") > 0) | (F.size("_hex") > 0) | (F.size("_copy") > 0), F.xxhash64(t)).alias("repo"),
        F.sort_array(
            F.concat(
                _candidate(assign, 0, group2), _candidate(places["access"], 1, same), _candidate(places["hex"], 2, same)
            )
        ).cast(CANDIDATE).alias("base"),
        F.transform(places["copy"], lambda s: worded(s["value"], s["start"])).alias("tokens"),
    )


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, words (their number), n_occurrences, n_repos, n_owners, verdict (example, live or weak)."""
    each = scanned.select("owner", "repo", F.explode("base").alias("c"))
    by = each.groupBy(F.col("c.hash").alias("hash")).agg(
        F.count(F.lit(1)).alias("n_occurrences"),
        F.countDistinct("repo").alias("n_repos"),
        F.countDistinct(F.coalesce(F.concat(F.lit("="), F.col("owner")), F.lit(""))).alias("n_owners"),
        F.max("c.words").alias("words"),
        F.max("c.live").alias("live"),
    )
    verdict = F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example").when(F.col("live"), "live").otherwise("weak")
    return by.select("hash", "words", "n_occurrences", "n_repos", "n_owners", verdict.alias("verdict"))


def runs(scanned: DataFrame, sizes: list[int]) -> DataFrame:
    """row_id, base and t (a candidate) for every run of a token's words that may be
    a live value: of a number of words in ``sizes``, with a digit and a letter, and
    with the punctuation around it as long as a value."""
    tokens = scanned.where(F.size("tokens") > 0).select("row_id", "base", F.explode("tokens").alias("p"))
    every = F.array(*map(F.lit, sizes)).cast("array<int>")
    tokens = tokens.withColumn("_k", F.explode(F.filter(every, lambda k: k <= F.size("p"))))

    def one(i: Column) -> Column:
        return F.transform(F.array(F.slice("p", i, F.col("_k"))), run)

    def run(parts: Column) -> Column:
        first, last = F.element_at(parts, 1), F.element_at(parts, -1)
        may = F.exists(parts, lambda p: p["digit"]) & F.exists(parts, lambda p: p["letter"]) & (last["high"] - first["low"] >= VALUE_CHARS)
        rank = KINDS.index("copy")
        return F.when(
            may,
            F.struct(
                first["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"),
                last["end"].alias("end"), hashed(parts).alias("hash"),
            ),
        )

    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size("p") - F.col("_k") + 1), one))
    return tokens.select("row_id", "base", F.explode(every).alias("t")).where("t IS NOT NULL")


def secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """row_id, doc_id, base (spans), copies (spans of known live values that no
    base span covers), n_live and n_example (base spans by verdict), live (all
    spans of live values, base and copies)."""
    scanned = durable(scan(docs, owner), "secrets-scan")
    known = durable(ownership(scanned), "secrets-owners")
    covered = F.exists("base", lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"]))
    span = ("start", "rank", "kind", "end", "hash")
    base = scanned.select("row_id", F.explode("base").alias("t")).select("row_id", *(f"t.{c}" for c in span))
    # How many words live values have: a few small numbers, each once.
    sizes = sorted(r.words for r in known.where("verdict = 'live' AND words > 0").select("words").distinct().collect())
    tokens = runs(scanned, sizes).where(~covered).select("row_id", *(f"t.{c}" for c in span))
    judged = base.unionByName(tokens).join(known.select("hash", "verdict"), "hash")
    is_copy, live = F.col("rank") == KINDS.index("copy"), F.col("verdict") == "live"
    place = F.struct("start", "rank", "kind", "end")
    some = lambda c, x: F.sort_array(F.collect_list(F.when(c, x)))
    by_row = judged.groupBy(F.col("row_id").alias("_row")).agg(
        some(is_copy & live, place).alias("copies"),
        some(live, place).alias("live"),
        F.count_if(~is_copy & live).alias("n_live"),
        F.count_if(~is_copy & (F.col("verdict") == "example")).alias("n_example"),
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return scanned.join(by_row, F.col("row_id") == F.col("_row"), "left").select(
        "row_id", "doc_id",
        F.transform("base", lambda b: F.struct(*(b[c].alias(c) for c in ("start", "rank", "kind", "end")))).alias("base"),
        *(F.coalesce(c, none).alias(c) for c in ("copies", "live")),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_live", "n_example")),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets(documents(spark, sf_dir))
    every = F.sort_array(F.concat("base", "copies"))
    return rows.select(
        "doc_id",
        *(number_of(F.col("base"), k).alias(f"n_{k}") for k in PATTERNS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        "n_live",
        "n_example",
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by ``[SECRET]``."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        keep = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], keep, F.lit("[SECRET]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).cast("bigint").alias("at"), out.alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(spans, zero, step, end)


def redact_documents(docs: DataFrame, owner: str = "source") -> DataFrame:
    """The documents with live secrets redacted; no document goes.

    Only the few rows with a live secret change. Rows are matched by doc_id and
    the hash of the text, in which equal rows have equal spans.
    """
    columns = docs.columns
    same = ("doc_id", F.xxhash64(whole("text")).alias("_hash"), F.length(whole("text")).alias("_n"))
    withid = docs.select(F.struct(*same).alias("doc_id"), F.col(owner).alias("owner"), "text")
    live = (
        durable(secrets(withid, "owner").where(F.size("live") > 0), "secrets-live")
        .groupBy("doc_id")
        .agg(F.max("live").alias("_live"))
        .select(F.col("doc_id").alias("_key"), "_live")
    )
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")  # away from the names used here
    rows = docs.select(row, F.col("text").alias("_text"), F.struct(*same).alias("_doc"))
    rows = rows.join(live, F.col("_doc") == F.col("_key"), "left")
    hit = F.col("_live").isNotNull()
    rows = rows.withColumn("_new", F.when(hit, redacted(F.col("_text"), F.col("_live"))).otherwise(F.col("_text")))
    given = {"text": F.col("_new")}
    if "n_chars" in columns:
        n = F.when(hit, F.length("_new")).otherwise(F.col("_row")["n_chars"])
        given["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return rows.select(*(given.get(c, F.col("_row")[c]).alias(c) for c in columns))
