"""Batch question answering: one plan for a table of questions.

Questions are split by what the guard says. Refusals never reach the search: their
branch reads the manifest at most. What is left is searched, and either not found,
or generated and enforced.
"""

from __future__ import annotations

import traceback

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.config import Settings
from citewell.errors import CorpusEmptyError, GenerationError
from citewell.functions import guard
from citewell.functions.text import freshness_line
from citewell.operators import enforce as rules
from citewell.operators import generate as writers
from citewell.operators import retrieve as search
from citewell.operators import store
from citewell.operators.buckets import Version
from citewell.operators.encode import Loader, encode
from citewell.operators.enforce import ACTIONS, CITATION, ERROR, FACTUAL, NOT_FOUND, REFUSAL
from citewell.operators.index import Index

STATIC = "static"
#: Our wording.
TEXTS = {
    guard.REFUSE_PII: (
        "Personal identifiers are neither needed nor kept here, so this request can't be served. Please leave out id "
        "numbers, account numbers, one-time passwords, email addresses and phone numbers."
    ),
    guard.REFUSE_ADVICE: (
        "Only published facts are given here, not advice, recommendations or help with choosing. The linked page explains "
        "how to weigh such questions."
    ),
    guard.REFUSE_PERFORMANCE: (
        "Returns are not computed, compared or forecast here. The linked page has the official record."
    ),
    guard.NOT_IN_SOURCES: rules.NOT_FOUND_TEXT,
}
SETUP = "The corpus has not been built yet."
APOLOGY = "Something went wrong while this answer was prepared. Please ask again."
EDUCATION_URL = "https://education.example.org/"

#: The columns of an answer.
ANSWER = (
    "query_id", "kind", "text", "citations", "last_updated", "generation_mode", "guard", "max_similarity", "actions",
    "prompt_chars", "llm_latency_ms", "corpus_fingerprint", "recorded",
)


def sent(rows: DataFrame) -> DataFrame:
    """A manifest goes out to all workers, for most rows name no scheme or share a page, and
    would meet in one task; one of over ``search.SENT`` rows is joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(search.SENT + 1).count() <= search.SENT else rows


def scheme_page(questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """``questions`` with the url of the scheme that they name, or null."""
    pages = sent(manifest.select(F.col("scheme_id").alias("_id"), F.col("url").alias("page_url")))
    return questions.join(pages, F.col("scheme_id") == F.col("_id"), "left").drop("_id")


def scheme_of_url(rows: DataFrame, manifest: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with the name of the scheme whose page is exactly ``url``, or ""."""
    names = sent(manifest.groupBy(F.col("url").alias("_url")).agg(F.min("scheme_name").alias("scheme_name")))
    joined = rows.drop("scheme_name").join(names, F.col(url) == F.col("_url"), "left").drop("_url")
    return joined.withColumn("scheme_name", F.coalesce("scheme_name", F.lit("")))


def static_text(text: Column, fetched_at: Column) -> Column:
    return F.concat(text, F.lit(" "), freshness_line(fetched_at))


def static_answers(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """From kind, body, url (null: no citation) and actions."""
    named = scheme_of_url(rows, manifest)
    cited = F.array(F.struct("url", F.lit("").alias("section"), "scheme_name")).cast(CITATION)
    return named.select(
        "query_id", "kind",
        static_text(F.col("body"), F.col("max_fetched_at")).alias("text"),
        F.when(F.col("url").isNotNull(), cited).otherwise(F.array().cast(CITATION)).alias("citations"),
        F.col("max_fetched_at").alias("last_updated"),
        F.lit(STATIC).alias("generation_mode"),
        "guard", "max_similarity", "actions",
        F.lit(0).alias("prompt_chars"), F.lit(None).cast("bigint").alias("llm_latency_ms"),
        "corpus_fingerprint", F.lit(True).alias("recorded"),
    )


def error_answers(rows: DataFrame, text: str, actions: list[str]) -> DataFrame:
    """Neither date nor citation, and no turn is recorded."""
    return rows.select(
        "query_id", F.lit(ERROR).alias("kind"), F.lit(text).alias("text"), F.array().cast(CITATION).alias("citations"),
        F.lit(None).cast("string").alias("last_updated"), F.lit(STATIC).alias("generation_mode"), "guard",
        F.lit(None).cast("double").alias("max_similarity"), F.array(*map(F.lit, actions)).cast(ACTIONS).alias("actions"),
        F.lit(0).alias("prompt_chars"), F.lit(None).cast("bigint").alias("llm_latency_ms"),
        "corpus_fingerprint", F.lit(False).alias("recorded"),
    )


def guarded(questions: DataFrame, aliases: DataFrame, query: str = "query") -> DataFrame:
    """query_id, query (redacted), guard, scheme_id: the raw question stops here."""
    rows = questions.withColumn("guard", guard.classify(query)).withColumn("query", F.col("guard.redacted_query"))
    return search.resolve_scheme(rows, aliases)


def _refusal(education: str) -> dict[str, Column]:
    action = F.col("guard.action")
    body = F.create_map(*(F.lit(x) for kv in TEXTS.items() for x in kv))
    return {
        "kind": F.when(action == guard.NOT_IN_SOURCES, NOT_FOUND).otherwise(REFUSAL),
        "body": F.element_at(body, action),
        "url": F.when(action == guard.REFUSE_PII, F.lit(None).cast("string"))
        .when(action == guard.REFUSE_ADVICE, F.lit(education))
        .otherwise(F.coalesce("page_url", F.lit(education))),
        "max_similarity": F.lit(None).cast("double"),
        "actions": F.array(F.concat(F.lit("refused:"), action), F.lit("retrieval_skipped")),
    }


def _unfound(education: str) -> dict[str, Column]:
    return {
        "kind": F.lit(NOT_FOUND), "body": F.lit(rules.NOT_FOUND_TEXT), "url": F.coalesce("page_url", F.lit(education)),
        "max_similarity": F.col("max_similarity"), "actions": F.array(F.lit("retrieval_empty")),
    }


def refusals(rows: DataFrame, manifest: DataFrame, education: str = EDUCATION_URL) -> DataFrame:
    refused = scheme_page(rows.where(F.col("guard.action") != guard.ANSWER), manifest)
    return static_answers(refused.withColumns(_refusal(education)), manifest)


def not_found(rows: DataFrame, manifest: DataFrame, education: str = EDUCATION_URL) -> DataFrame:
    """Questions whose search gave nothing."""
    return static_answers(scheme_page(rows, manifest).withColumns(_unfound(education)), manifest)


def unsearched(rows: DataFrame, manifest: DataFrame, education: str = EDUCATION_URL) -> DataFrame:
    """Refusals, and NOT_FOUND for the rest, in one pass: no question is classified twice.
    Texts of questions stay behind."""
    lean = F.col("guard").withField("redacted_query", F.lit(None).cast("string"))
    rows = scheme_page(rows.drop("query").withColumn("guard", lean), manifest)
    refused, rest = _refusal(education), _unfound(education)
    known = F.col("guard.action") != guard.ANSWER
    return static_answers(rows.withColumns({c: F.when(known, refused[c]).otherwise(rest[c]) for c in refused}), manifest)


def factual(rows: DataFrame, s: Settings, client: writers.ClientLoader | None = None) -> DataFrame:
    written = writers.generate(rows, s, client)
    checked = rules.enforce(rows.join(written, "query_id"), s)
    return checked.withColumn("recorded", F.lit(True)).select(*ANSWER)


def facts_of(corpus: DataFrame) -> tuple[str | None, str]:
    """The last date and the fingerprint, by one pass over dates and ids."""
    date = F.max(F.when(F.col("fetched_at") != "", F.col("fetched_at"))).alias("last")
    one = corpus.agg(date).join(store.set_fingerprint(corpus)).first()
    return one["last"], one["fingerprint"]


def answer(
    questions: DataFrame,
    corpus: DataFrame,
    manifest: DataFrame,
    aliases: DataFrame,
    s: Settings = Settings(),
    *,
    load: Loader | None = None,
    dimensions: int | None = None,
    client: writers.ClientLoader | None = None,
    education: str = EDUCATION_URL,
    version: Version | None = None,
    index: Index | None = None,
) -> DataFrame:
    """One answer per question (query_id, query). ``corpus`` has the chunk columns,
    embedding and body_embedding, made by the same encoder. Of a corpus read from a store of
    buckets, ``version`` gives date and fingerprint, and no row is read for them; ``index``
    over it is searched in place of all rows."""
    # Stored once, redacted: every branch below starts from what the guard says.
    rows = store.checkpointed(guarded(questions, aliases).select("query_id", "query", "guard", "scheme_id"))
    last, print_ = (version.max_fetched_at, version.fingerprint) if version else facts_of(corpus)
    rows = rows.withColumn("max_fetched_at", F.lit(last).cast("string"))
    rows = rows.withColumn("corpus_fingerprint", F.lit(print_))
    refused = refusals(rows, manifest, education)
    open_ = rows.where(F.col("guard.action") == guard.ANSWER)
    if not version.rows if version else store.is_empty(corpus):
        return refused.unionByName(error_answers(open_, SETUP, ["corpus_empty"]))
    asked = encode(open_, "query", "embedding", load, dimensions or s.dimensions)
    found = search.results(asked, search.retrieve(asked, corpus, s, empty_check=False, index=index))
    open_ = open_.drop("max_similarity").join(found.drop("filtered_scheme_id"), "query_id")
    return (
        refused.unionByName(not_found(open_.where("is_empty"), manifest, education))
        .unionByName(factual(open_.where("NOT is_empty"), s, client))
        .select(*ANSWER)
    )


def warm_up(corpus: DataFrame, load: Loader | None = None, dimensions: int = Settings.dimensions) -> DataFrame:
    """The corpus held in memory where it fits, and an encoder loaded: for sessions
    that answer many batches. The caller unpersists it."""
    held = corpus.persist()
    one = held.sparkSession.createDataFrame([("warm",)], "text string")
    encode(one, "text", "embedding", load, dimensions).count()
    held.count()
    return held


def failed(questions: DataFrame, e: BaseException) -> DataFrame:
    """An answer for each question of a batch that could not be planned: what kind
    of error and where, but not its message."""
    frames = traceback.extract_tb(e.__traceback__)[-5:]
    where = " -> ".join(f"{f.filename.rpartition('/')[2]}:{f.lineno}" for f in frames)
    if isinstance(e, CorpusEmptyError):
        text, actions = SETUP, ["corpus_empty"]
    elif isinstance(e, GenerationError):
        text, actions = APOLOGY, ["llm_error"]
    else:
        text, actions = APOLOGY, [f"pipeline_error:{type(e).__name__}", f"pipeline_frames:{where}"]
    rows = questions.select("query_id", guard.classify("query").alias("guard"), F.lit("").alias("corpus_fingerprint"))
    return error_answers(rows, text, actions)


__all__ = ["ANSWER", "FACTUAL", "answer", "factual", "failed", "guarded", "not_found", "refusals", "static_answers", "unsearched"]
