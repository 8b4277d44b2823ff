"""Registered queries of the engine, each with the SQL that DuckDB can run instead.

Queries take (spark, sf_dir) and read whole tables. Their SQL is written apart from
the operators, against the definition and not the code; only fixed values of the
definition (abbreviations, tracking keys, stop words, the pattern of figures) are
taken from where they stand. More queries are in ``fold_queries`` and ``wide_queries``;
small cases with known results, for the tests, are at their subjects here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.functions import text
from citewell.operators import chunking, durable, enforce, generate, retrieve, sections, sessions, store
from citewell.operators.encode import encode
from citewell.plans import answer as answers
from citewell.plans import evaluate, ingest
from citewell.sources import tables
from citewell.streaming.sessions import event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table under this many bytes may be one row group, which one task would read alone.
SMALL = 64 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """A small table dealt to all cores, for queries that compute much per row."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows if size > SMALL else rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


# SQL building blocks ---------------------------------------------------------------

BLANK = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINES = r"\r\n|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
NEWLINE = "chr(10)"


def sql_ws(x: str) -> str:
    folded = (
        f"translate({x}, chr(8216) || chr(8217) || chr(8219) || chr(8220) || chr(8221) || chr(8222) || chr(8242) || chr(8243)"
        " || chr(8211) || chr(8212) || chr(8722) || chr(8204) || chr(8205) || chr(65279), '''''''\"\"\"''\"---')"
    )
    return f"trim(regexp_replace({folded}, '{BLANK}+', ' ', 'g'))"


def sql_lines(x: str) -> str:
    each = f"list_transform(regexp_split_to_array({x}, '{LINES}'), lambda l: {sql_ws('l')})"
    return f"array_to_string(list_filter({each}, lambda l: l <> ''), {NEWLINE})"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else "\\" + c for c in word)


def sql_header(section: str) -> str:
    return f"'[Scheme: ' || coalesce(source, '') || ' | Category: ' || coalesce(lang, '') || ' | Plan: Direct | Section: ' || {section} || ']'"


#: The title of a document's one section.
SECTION = f"coalesce({sql_ws("'Section ' || lang")}, 'Untitled')"
_ABBR = "|".join(map(_either_case, text.ABBREVIATIONS))
#: Marks: no boundary here, a boundary, and a text's own character that marks begin with.
_HELD, _CUT, _OWN = "\ue000\ue001", "\ue000\ue002", "\ue000\ue003"


def sql_sentences(x: str) -> str:
    """A list: what ends no sentence is held, boundaries are marked, then split. RE2 has no
    look-around: neighbours share the character between them, so the second of two is held in a second pass."""
    at = f"replace({x}, '\ue000', '{_OWN}')"
    steps = (
        *2 * ((rf"(^|[^A-Za-z.])(\.*(?:{_ABBR})\.+)([ \t\n])", rf"\1\2{_HELD}\3"),),
        *2 * ((r"(\p{Nd}[.!?…]+)([ \t]+\p{Nd})", rf"\1{_HELD}\2"),),
        (r"([.!?…])([ \t]+\p{Ll})", rf"\1{_HELD}\2"),
        (r"([.!?…])[ \t]+", rf"\1{_CUT}"),
        (rf"({_HELD}[ \t]*\n+)|\n+", rf"\1{_CUT}"),
        (rf"({_HELD}[ \t]*\n+){_CUT}", r"\1"),
    )
    for pattern, into in steps:
        at = f"regexp_replace({at}, '{pattern}', '{into}', 'g')"
    shown = f"replace(replace(s, '{_HELD}', ''), '{_OWN}', '\ue000')"
    pieces = f"list_transform(string_split({at}, '{_CUT}'), lambda s: regexp_replace({shown}, '^{BLANK}+|{BLANK}+$', '', 'g'))"
    return f"list_filter({pieces}, lambda s: s <> '')"


def sql_url(x: str) -> str:
    """Canonical url, in nested steps."""
    cut = f"rtrim(regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g'), '.,;:!?)' || chr(12305) || chr(65341) || chr(12297) || chr(12299) || chr(12301) || chr(12303) || chr(12309))"
    bare = f"regexp_replace({cut}, '^(?i:https?)://', '')"
    head = f"split_part(split_part({bare}, '?', 1), '#', 1)"
    host = f"regexp_replace(lower(split_part({head}, '/', 1)), '^www\\.', '')"
    path = f"CASE WHEN contains({head}, '/') THEN rtrim({head}[strpos({head}, '/') + 1:], '/') ELSE '' END"
    tracking = ", ".join(f"'{t}'" for t in text.TRACKING)
    key = "lower(trim(split_part(p, '=', 1)))"
    pairs = f"CASE WHEN contains({bare}, '?') THEN string_split({bare}[strpos({bare}, '?') + 1:], '&') ELSE [] END"
    kept = f"list_sort(list_filter({pairs}, lambda p: p <> '' AND NOT starts_with({key}, 'utm_') AND {key} NOT IN ({tracking})))"
    tail = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    full = f"(({path}) || ({tail}))"
    return f"({host} || CASE WHEN {full} <> '' THEN '/' || {full} ELSE '' END)"


NUMBER_SQL = text.NUMBER.replace("'", "''")
STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(text.STOPWORDS))


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP_SQL}))"


# Text functions ---------------------------------------------------------------------


@query(f"SELECT doc_id, {sql_ws('text')} AS norm FROM documents")
def normalize_ws_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_ws("text").alias("norm"))


@query(f"SELECT doc_id, {sql_lines('text')} AS norm FROM documents")
def normalize_lines_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_lines("text").alias("norm"))


@query(f"WITH s AS (SELECT doc_id, {sql_sentences("coalesce(text, '')")} AS s FROM documents) SELECT doc_id, len(s)::INT AS n, array_to_string(s, '|') AS joined FROM s")
def sentences_docs(spark, d):
    s = dealt(table(spark, d, "documents")).select("doc_id", text.split_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.array_join("s", "|").alias("joined"))


@query(
    f"WITH s AS (SELECT doc_id, coalesce(text, '') AS text, {sql_sentences("coalesce(text, '')")} AS s FROM documents) "
    "SELECT doc_id, len(s)::INT AS n, CASE WHEN len(s) <= 2 THEN text ELSE array_to_string(s[1:2], ' ') END AS cut FROM s"
)
def truncate_docs(spark, d):
    t = dealt(table(spark, d, "documents")).select("doc_id", text.truncate_sentences("text", 2).alias("t"))
    return t.select("doc_id", F.col("t.sentences").alias("n"), F.col("t.text").alias("cut"))


@query(f"SELECT page_id, {sql_url('url')} AS canonical FROM pages")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", text.normalize_url("url").alias("canonical"))


@query(
    f"SELECT page_id, [rtrim(url, '.,;:!?)]}}' || chr(39) || chr(34)), rtrim(url, '.,;:!?)') || '/more'] AS urls FROM pages"
)
def url_extract(spark, d):
    pages = table(spark, d, "pages")
    line = F.format_string("see [page](%s) or %s. Also %s/more, ok", "url", "url", "url")
    return pages.select("page_id", text.extract_urls(line).alias("urls"))


@query(
    f"WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{NUMBER_SQL}'), lambda x: trim(x)) AS n FROM documents), "
    "u AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(n) AS x, generate_subscripts(n, 1) AS i FROM n) GROUP BY doc_id, x) "
    "SELECT doc_id, string_agg(x, '|' ORDER BY i) AS forms, count(*) AS n FROM u GROUP BY doc_id"
)
def number_forms(spark, d):
    n = table(spark, d, "documents").select("doc_id", text.extract_numbers("text").alias("n")).where(F.size("n") > 0)
    return n.select("doc_id", F.array_join("n", "|").alias("forms"), F.size("n").cast("bigint").alias("n"))


@query(f"SELECT doc_id, regexp_replace(text, '{BLANK}+([%)\\]])', '\\1', 'g') AS canonical FROM documents")
def number_canonical(spark, d):
    return table(spark, d, "documents").select("doc_id", text.canonical_number("text").alias("canonical"))


@query(
    rf"""
WITH n AS (SELECT doc_id, text AS t, trim(regexp_extract(text, '{NUMBER_SQL}')) AS num FROM documents),
r AS (SELECT doc_id, num, t[:strpos(t, num) - 1] || t[strpos(t, num) + length(num):] AS t FROM n WHERE num <> ''),
p AS (SELECT doc_id, num, regexp_replace(t, '[ \t]+([.,;:!?])', '\1', 'g') AS t FROM r),
c AS (SELECT doc_id, num, regexp_replace(regexp_replace(t, '[ \t]{{2,}}', ' ', 'g'), '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM p)
SELECT doc_id, num, regexp_replace(t, '^(?:{BLANK}|[,;:])+|(?:{BLANK}|[,;:])+$', '', 'g') AS stripped FROM c
"""
)
def number_strip(spark, d):
    n = table(spark, d, "documents").select("doc_id", "text", F.get(text.extract_numbers("text"), F.lit(0)).alias("num"))
    return n.where("num IS NOT NULL").select("doc_id", "num", text.strip_number("text", F.col("num")).alias("stripped"))


@query("SELECT doc_id, ceil(length(text) / 4)::INT AS tokens, ceil(length(text) / 4) > 256 AS over FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.count_tokens("text").alias("tokens"), text.exceeds_limit("text").alias("over")
    )


@query(f"WITH t AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents) SELECT doc_id, len(t)::INT AS n, array_to_string(t, ' ') AS tokens FROM t")
def content_tokens_docs(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.content_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(
    "WITH h AS (SELECT doc_id, text, '[Scheme: ' || source || ' | Category: ' || lang || ' | Plan: p | Section: ' || doc_id || ']' AS header FROM documents) "
    "SELECT doc_id, header, greatest(1, 240 - ceil(length(header) / 4) - 1)::INT AS budget, text AS stripped, sha256(header || chr(10) || text) AS hash FROM h"
)
def context_headers(spark, d):
    h = table(spark, d, "documents").withColumn(
        "header", text.context_header(F.col("source"), F.col("lang"), F.lit("p"), F.col("doc_id").cast("string"))
    )
    full = F.concat("header", F.lit("\n"), "text")
    return h.select(
        "doc_id", "header", text.body_budget(F.col("header")).alias("budget"),
        text.strip_context_header(full).alias("stripped"), F.sha2(full, 256).alias("hash"),
    )


# Guard -------------------------------------------------------------------------------

#: Question, action, pattern: what the guard must say.
GOLDEN = (
    ("Should I invest in the Large Cap Fund?", "refuse_advice", "ADVICE_INTENT"),
    ("Which is the best fund among these five?", "refuse_advice", "ADVICE_PREFERENCE"),
    ("Is the Small Cap Fund safe for me?", "refuse_advice", "ADVICE_SUITABILITY"),
    ("Is now a good time to buy the tax saver?", "refuse_advice", "ADVICE_INTENT"),
    ("How much should I allocate to it?", "refuse_advice", "ADVICE_INTENT"),
    ("Recommend a mutual fund for retirement.", "refuse_advice", "ADVICE_PREFERENCE"),
    ("Is the Balanced Fund right for a 25 year old?", "refuse_advice", "ADVICE_SUITABILITY"),
    ("What is the 1 year return of the Large Cap Fund?", "refuse_performance", "PERF_FORECAST"),
    ("Which of these funds performed best last year?", "refuse_performance", "PERF_RANKING"),
    ("How much will I make if I invest 100000 for 10 years?", "refuse_performance", "PERF_FORECAST"),
    ("Compare the returns of the two.", "refuse_performance", "PERF_COMPARISON"),
    ("What is the CAGR of the tax saver?", "refuse_performance", "PERF_FORECAST"),
    ("My PAN is ABCDE1234F, can you check my returns?", "refuse_pii", "PAN"),
    ("My number is 2345 6789 0123, please update.", "refuse_pii", "AADHAAR"),
    ("Email me at some.one@mail.example about it.", "refuse_pii", "EMAIL"),
    ("My account number is 30123456789, what is the NAV?", "refuse_pii", "ACCOUNT_NUMBER"),
    ("The OTP is 482913, can you verify?", "refuse_pii", "OTP"),
    ("Call me on +91 98765 43210 with the details.", "refuse_pii", "PHONE_IN"),
    ("My phone number is 9876543210.", "refuse_pii", "PHONE_IN"),
    ("XXXX XXXX 4567 - update my status.", "refuse_pii", "AADHAAR_MASKED"),
    ("What is the expense ratio of the Large Cap Fund?", "answer", None),
    ("Is there an exit load on the Equity Fund?", "answer", None),
    ("What is the minimum lump sum?", "answer", None),
    ("How do I get my account statement?", "answer", None),
    ("", "answer", None),
)
ALIASES = (
    ("large", "large cap"), ("large", "largecap"), ("flexi", "flexi cap"), ("flexi", "equity fund"), ("tax", "tax saver"),
    ("small", "small cap"), ("balanced", "balanced advantage"),
)

# Sections and chunks --------------------------------------------------------------------


def documents_as_pages(spark, d) -> DataFrame:
    """Each document as a page of one section; the source stands for the scheme."""
    docs = dealt(table(spark, d, "documents"))
    section = F.struct(
        F.concat(F.lit("Section "), "lang").alias("section_title"),
        F.lit(2).alias("heading_level"),
        F.coalesce("text", F.lit("")).alias("text"),
        sections.is_table_block(F.coalesce("text", F.lit(""))).alias("is_table"),
        F.lit(0).alias("order"),
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("scheme_id"), F.col("source").alias("scheme_name"), F.col("lang").alias("category"),
        F.lit("Direct").alias("plan"), F.concat(F.lit("https://pages.example/"), F.col("doc_id").cast("string")).alias("final_url"),
        F.lit("documents").alias("extraction_mode"), F.array(section).alias("sections"),
    )


def built(spark, d) -> DataFrame:
    return sections.build_documents(documents_as_pages(spark, d), F.lit("2026-01-31"))


@query(f"SELECT doc_id::VARCHAR AS scheme_id, 'https://pages.example/' || doc_id AS source_url, sha256({sql_ws(sql_lines('text'))}) AS content_sha256, 1::INT AS n FROM documents")
def build_documents(spark, d):
    return built(spark, d).select("scheme_id", "source_url", "content_sha256", F.size("sections").alias("n"))


@query(
    rf"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{LINES}')) AS raw, generate_subscripts(regexp_split_to_array(text, '{LINES}'), 1) AS i FROM documents),
t AS (SELECT doc_id, i, regexp_replace(raw, '^{BLANK}+|{BLANK}+$', '', 'g') AS x FROM l),
k AS (SELECT doc_id, i, CASE WHEN x = '' THEN 'blank'
    WHEN regexp_matches(x, '^{BLANK}*[\pL\pN_ ()%/-]{{2,40}}{BLANK}*[:\-]{BLANK}*[^\s]+') OR regexp_matches(x, '(?i)^.{{2,60}}?{BLANK}+(?:₹|rs\.?{BLANK}*)?[\d,]+(?:\.\d+)?{BLANK}*%?$') THEN 'pair'
    WHEN NOT contains(replace(replace(replace(x, '₹', ''), 'Rs.', ''), 'rs.', ''), ' ') AND regexp_matches(x, '(?i)^(?:[+-]|₹|rs\.?)?\s*[\d,]+(?:\.\d+)?\s*%?$') THEN 'value'
    ELSE 'label' END AS kind FROM t),
p AS (SELECT doc_id, kind, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k)
SELECT doc_id, count(*) FILTER (kind = 'pair' OR kind = 'value' AND prev = 'label')::INT AS pairs,
       count(*) FILTER (kind = 'pair' OR kind = 'value' AND prev = 'label') >= 3 AS is_table FROM p GROUP BY doc_id
"""
)
def table_block_flag(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id", sections.count_pairs(text.split_lines("text")).alias("pairs"), sections.is_table_block(F.col("text")).alias("is_table")
    )


#: Scheme, house and prose figures, and the prose after repair.
REPAIRS = (
    ("a", "Fund size (AUM) ₹38,000 Cr", "Total AUM ₹7,00,000 Cr", "Asset Under Management(AUM) of 7,00,000 Cr today", "Asset Under Management(AUM) of ₹38,000 Cr today"),
    ("b", "Fund size (AUM) ₹38,000 Cr", "Total AUM ₹7,00,000.4 Cr", "Asset Under Management (AUM) is ₹7,00,001 Cr.", "Asset Under Management (AUM) is ₹38,000 Cr."),
    ("c", "Fund size (AUM) ₹38,000 Cr", "Total AUM ₹7,00,000 Cr", "Asset Under Management(AUM) of ₹38,000 Cr", "Asset Under Management(AUM) of ₹38,000 Cr"),
    ("d", "Fund size (AUM) ₹38,000 Cr", "Total AUM ₹7,00,000 Cr", "Asset Under Management(AUM) of ₹500 Cr", "Asset Under Management(AUM) of ₹500 Cr"),
    ("e", "no figure", "Total AUM ₹7,00,000 Cr", "Asset Under Management(AUM) of 7,00,000 Cr", "Asset Under Management(AUM) of 7,00,000 Cr"),
    ("f", "Fund size (AUM) ₹38,000 Cr", "nothing", "Asset Under Management(AUM) of 7,00,000 Cr", "Asset Under Management(AUM) of 7,00,000 Cr"),
)


def repair_input(spark) -> DataFrame:
    rows = spark.createDataFrame([r[:4] for r in REPAIRS], "scheme_id string, a string, b string, c string")
    part = lambda c, k: F.struct(
        F.lit(c).alias("section_title"), F.lit(2).alias("heading_level"), F.col(c).alias("text"), F.lit(False).alias("is_table"), F.lit(k).alias("order")
    )
    names = ("scheme_name", "category", "plan", "final_url", "extraction_mode")
    return rows.select("scheme_id", *(F.lit("x").alias(n) for n in names), F.array(part("a", 0), part("b", 1), part("c", 2)).alias("sections"))


@query(
    "SELECT count(*) AS sources_ok, 2::INT AS n_failed, '2026-01-31' AS max_fetched_at, count(*)::INT AS n_documents, 2::INT AS n_warnings FROM documents"
)
def ingest_report(spark, d):
    failed = spark.createDataFrame([("x", "HTTP 500"), ("y", "timeout")], "scheme_id string, error string")
    one = ingest.report(built(spark, d), failed)
    return one.select(
        "sources_ok", F.size("sources_failed").alias("n_failed"), "max_fetched_at", F.size("documents").alias("n_documents"),
        F.size("warnings").alias("n_warnings"),
    )


@query(
    f"""
WITH l AS (SELECT doc_id, string_split({sql_lines('text')}, {NEWLINE}) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l),
f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY doc_id, x)
SELECT doc_id, count(*)::INT AS n_kept, sha256(string_agg(x, {NEWLINE} ORDER BY i)) AS kept FROM f GROUP BY doc_id
"""
)
def chunk_dedupe(spark, d):
    lines = F.split(text.normalize_lines("text"), "\n", -1)
    pieces = F.transform(lines, lambda x: F.struct(F.lit("s").alias("section"), F.lit(0).alias("order"), F.lit(False).alias("is_table"), x.alias("body")))
    docs = table(spark, d, "documents").select("doc_id", pieces.alias("p")).select("doc_id", chunking.dedupe_pieces(F.col("p")).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["body"]), "\n")
    return docs.select("doc_id", F.size("p").alias("n_kept"), F.sha2(body, 256).alias("kept"))


_CHUNK_SQL = f"""
c AS (SELECT doc_id, source, lang, {sql_lines('text')} AS body FROM documents),
e AS (SELECT *, {sql_header(SECTION)} || chr(10) || body AS embed_text,
        sha256('https://pages.example/' || doc_id || '|0|0|' || body)[:16] AS chunk_id FROM c)
"""


def documents_as_chunks(spark, d) -> DataFrame:
    """Each document as one chunk, whatever its length."""
    whole = F.transform(
        "sections",
        lambda s: F.struct(s["section_title"].alias("section"), s["order"].alias("order"), s["is_table"].alias("is_table"), s["text"].alias("body")),
    )
    rows = built(spark, d).withColumn("pieces", whole)
    return chunking.number_pieces(rows)


@query(f"WITH {_CHUNK_SQL} SELECT chunk_id, doc_id::VARCHAR AS scheme_id, 0::INT AS chunk_index, sha256(body) AS content_sha256, embed_text FROM e")
def chunk_ids(spark, d):
    return documents_as_chunks(spark, d).select("chunk_id", "scheme_id", "chunk_index", "content_sha256", "embed_text")


# Vectors -------------------------------------------------------------------------------

EVERY = 50  # questions are the vectors whose id is a multiple of it


def vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows, rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label")


_SIMS = f"""
s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, q.label AS q_label,
        list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS similarity
      FROM embeddings q, embeddings c WHERE q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
"""
_TOP = f"{_SIMS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 24)"
_NEAR = {"key": "vec_id", "exclude_self": True}


@query(f"WITH {_TOP} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM t")
def knn_topk(spark, d):
    rows, asked = vectors(spark, d)
    found = retrieve.nearest(rows, asked, 24, **_NEAR)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    f"WITH {_SIMS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE label = q_label) WHERE rank <= 24) "
    "SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM t"
)
def knn_filtered(spark, d):
    rows, asked = vectors(spark, d)
    found = retrieve.nearest(rows, asked, 24, filter_by="label", **_NEAR)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"WITH {_TOP} SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM t WHERE similarity >= 0.25")
def knn_threshold(spark, d):
    rows, asked = vectors(spark, d)
    found = retrieve.threshold(retrieve.nearest(rows, asked, 24, **_NEAR))
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_TOP} SELECT query_id, round(max(similarity), 6) AS max_similarity, round(1 - max(1 - similarity), 6) AS worst FROM t GROUP BY query_id")
def knn_max_similarity(spark, d):
    rows, asked = vectors(spark, d)
    found = retrieve.nearest(rows, asked, 24, **_NEAR).withColumn("distance", 1 - F.col("similarity"))
    return found.groupBy("query_id").agg(
        F.round(F.max("similarity"), 6).alias("max_similarity"), F.round(retrieve.similarity(F.max("distance")), 6).alias("worst")
    )


def candidates(spark, d) -> DataFrame:
    rows, asked = vectors(spark, d)
    found = retrieve.nearest(rows, asked, 24, **_NEAR)
    joined = found.join(rows.select("vec_id", F.col("label").alias("section"), F.col("embedding").alias("body_embedding")), "vec_id")
    return joined


_DISTINCT = f"{_TOP}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS nth FROM t) WHERE nth = 1)"


@query(f"WITH {_DISTINCT} SELECT query_id, vec_id, label AS section, rank::INT AS rank FROM u")
def section_dedupe(spark, d):
    return retrieve.best_of_section(candidates(spark, d)).select("query_id", "vec_id", "section", "rank")


@query(
    f"WITH {_DISTINCT} SELECT * FROM (SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank, NULL::DOUBLE AS mmr_score FROM u) WHERE rank <= 5"
)
def retrieval_first_k(spark, d):
    ranked = retrieve.first_k(retrieve.best_of_section(candidates(spark, d)), 5)
    return ranked.select("query_id", "vec_id", "rank", "mmr_score")


@query(
    f"""
WITH RECURSIVE {_DISTINCT},
c AS (SELECT u.query_id, u.vec_id, u.similarity, row_number() OVER (PARTITION BY u.query_id ORDER BY u.rank) AS place,
        count(*) OVER (PARTITION BY u.query_id) AS n, e.embedding::DOUBLE[] AS v FROM u JOIN embeddings e USING (vec_id)),
p AS (SELECT a.query_id, a.place AS i, b.place AS j, list_dot_product(a.v, b.v) AS alike FROM c a JOIN c b USING (query_id)),
r AS (
  SELECT query_id, 1 AS k, [place] AS sel, place AS last, similarity AS score FROM c WHERE place = 1 AND n > 5
  UNION ALL
  SELECT query_id, k + 1, list_append(sel, (-b.at)::BIGINT), (-b.at)::BIGINT, b.score
  FROM (
    SELECT query_id, k, sel, max({{'score': score, 'at': -place}}) AS b
    FROM (
      SELECT r.query_id, r.k, r.sel, c.place, 0.7 * c.similarity - (1.0 - 0.7) * max(p.alike) AS score
      FROM r JOIN c ON c.query_id = r.query_id AND NOT list_contains(r.sel, c.place)
             JOIN p ON p.query_id = r.query_id AND p.i = c.place AND list_contains(r.sel, p.j)
      WHERE r.k < 5 GROUP BY r.query_id, r.k, r.sel, c.place, c.similarity
    ) GROUP BY query_id, k, sel
  )
)
SELECT r.query_id, c.vec_id, r.k::INT AS rank, round(r.score, 6) AS mmr_score FROM r JOIN c ON c.query_id = r.query_id AND c.place = r.last
UNION ALL
SELECT query_id, vec_id, place::INT, round(similarity, 6) FROM c WHERE n <= 5
"""
)
def mmr_rerank(spark, d):
    ranked = retrieve.mmr(retrieve.best_of_section(candidates(spark, d)), 5)
    return ranked.select("query_id", "vec_id", "rank", F.round("mmr_score", 6).alias("mmr_score"))


@query()
def hashing_encode(spark, d):
    """A vector of every document."""
    rows = encode(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", "embedding")


# Store ----------------------------------------------------------------------------------


@query("SELECT count(*) AS count, max(lang) AS max_fetched_at, list_sort(list(DISTINCT source)) AS schemes FROM documents")
def corpus_stats(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("fetched_at"), F.col("source").alias("scheme_id"))
    return store.corpus_stats(docs)


@query("SELECT sha256(string_agg(doc_id::VARCHAR, '' ORDER BY doc_id::VARCHAR))[:12] AS fingerprint FROM documents")
def corpus_fingerprint(spark, d):
    return store.corpus_fingerprint(table(spark, d, "documents"), "doc_id")


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents stored before, and a batch: one language is gone from it, one is
    new, a source's texts have changed, and the rows of another come twice."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_sha256"), "lang", "source"
    )
    changed = F.when(F.col("source") == "src1", F.sha2(F.col("content_sha256"), 256)).otherwise(F.col("content_sha256"))
    batch = docs.where("lang <> 'de'").withColumn("content_sha256", changed)
    twice = batch.where("source = 'src2'").withColumn("content_sha256", F.lit("later"))
    both = batch.withColumn("at", F.lit(0)).unionByName(twice.withColumn("at", F.lit(1)))
    return docs.where("lang <> 'fr'").drop("lang", "source"), both.drop("lang", "source")


_OLD = "old AS (SELECT doc_id AS chunk_id, sha256(text) AS h FROM documents WHERE lang <> 'fr')"
_NEW = "new AS (SELECT doc_id AS chunk_id, CASE WHEN source = 'src1' THEN sha256(sha256(text)) ELSE sha256(text) END AS h FROM documents WHERE lang <> 'de')"


@query(f"WITH {_OLD}, {_NEW} SELECT chunk_id, h AS content_sha256 FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)")
def stale_anti_join(spark, d):
    old, new = _split(spark, d)
    return store.stale(old, new)


@query(f"WITH {_NEW} SELECT chunk_id, h AS content_sha256 FROM new")
def upsert_snapshot(spark, d):
    old, new = _split(spark, d)
    return store.snapshot(old, new, "at")


@query(
    f"WITH {_OLD}, {_NEW} SELECT count(*) FILTER (o.chunk_id IS NULL) AS inserted, count(*) FILTER (o.h <> n.h) AS updated, "
    "count(*) FILTER (o.h = n.h) AS unchanged, count(*) FILTER (n.chunk_id IS NULL) AS deleted FROM old o FULL JOIN new n USING (chunk_id)"
)
def merge_report(spark, d):
    old, new = _split(spark, d)
    return store.merge_report(old, store.first_by_id(new, "at"))


@query(f"WITH {_OLD}, {_NEW} SELECT n.chunk_id FROM new n JOIN old o ON o.chunk_id = n.chunk_id AND o.h = n.h")
def encode_skips_unchanged(spark, d):
    old, new = _split(spark, d)
    return store.unchanged(old, store.first_by_id(new, "at")).select("chunk_id")


@query("SELECT starts_with(url, 'https:') AS cached, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1")
def ingest_cache_join(spark, d):
    pages = table(spark, d, "pages")
    manifest = pages.select(
        F.col("page_id").cast("string").alias("scheme_id"), F.lit("name").alias("scheme_name"), F.lit("c").alias("category"), F.lit("p").alias("plan"), "url"
    )
    empty = F.array().cast("array<struct<section_title:string,heading_level:int,text:string,is_table:boolean,order:int>>")
    cached = pages.where("url LIKE 'https:%'").select(
        F.col("page_id").cast("string").alias("scheme_id"), *(F.lit("old").alias(c) for c in ("scheme_name", "category", "plan")),
        F.col("url").alias("source_url"), F.lit("2026-01-31").alias("fetched_at"), F.lit("h").alias("content_sha256"),
        F.lit("m").alias("extraction_mode"), empty.alias("sections"),
    )
    hits, missing = ingest.cached_and_missing(manifest, cached)
    both = hits.where("scheme_name = 'name'").select("scheme_id", F.lit(True).alias("cached"))
    both = both.unionByName(missing.select("scheme_id", F.lit(False).alias("cached")))
    return both.groupBy("cached").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("scheme_id").cast("bigint")).alias("first"))


# Citations --------------------------------------------------------------------------------


@query(
    "SELECT p.page_id, coalesce(m.name, '') AS scheme_name FROM pages p LEFT JOIN (SELECT url, min('page ' || page_id) AS name FROM pages WHERE contains(url, 'example.org') GROUP BY url) m ON m.url = p.url"
)
def scheme_of_url(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    manifest = pages.where(F.contains("url", F.lit("example.org"))).select("url", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("scheme_name"))
    return answers.scheme_of_url(pages, manifest).select("page_id", "scheme_name")


# Answers -----------------------------------------------------------------------------------

_PLAIN = "regexp_replace(text, '[.!?…]', '', 'g')"
_FIRST = "f AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations GROUP BY conv_id)"


@query(
    f"""
WITH {_FIRST}, q AS (SELECT conv_id AS query_id, {sql_tokens('query')} AS asked FROM f),
k AS (SELECT conv_id AS query_id, turn, role, {_PLAIN} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_at FROM conversations),
l AS (SELECT query_id, chunk_at, turn, role, unnest(string_split(t, {NEWLINE})) AS raw, generate_subscripts(string_split(t, {NEWLINE}), 1) AS pos FROM k),
s AS (SELECT query_id, chunk_at, turn, role, pos, trim(raw) AS x FROM l),
o AS (SELECT s.*, len(list_intersect(asked, {sql_tokens('x')})) AS overlap, len({sql_tokens('x')}) AS n FROM s JOIN q USING (query_id) WHERE x <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, length(x), chunk_at, pos) AS nth FROM o WHERE n > 0)
SELECT query_id, arg_min(role, chunk_at * 1000000 + pos) || ': ' || string_agg(x, ' ' ORDER BY chunk_at, pos)
  || ' Source: https://turns.example/' || arg_min(turn, chunk_at * 1000000 + pos) AS raw
FROM r WHERE nth <= 2 GROUP BY query_id
"""
)
def extractive_answer(spark, d):
    """The first turn of a conversation as the question, its turns as the chunks,
    whose sentences are their lines."""
    turns = table(spark, d, "conversations")
    chunk = F.struct(
        "turn", F.regexp_replace("text", "[.!?…]", "").alias("text"), F.col("role").alias("section"),
        F.concat(F.lit("https://turns.example/"), F.col("turn").cast("string")).alias("source_url"),
    )
    asked = turns.groupBy(F.col("conv_id").alias("query_id")).agg(
        F.min_by("text", "turn").alias("query"), F.sort_array(F.collect_list(chunk)).alias("chunks")
    )
    return generate.extractive(asked)


@query(
    f"WITH {_FIRST} SELECT conv_id, turn, len(list_intersect({sql_tokens('query')}, {sql_tokens('text')}))::INT AS overlap FROM conversations JOIN f USING (conv_id)"
)
def token_overlap(spark, d):
    turns = table(spark, d, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    return turns.join(first, "conv_id").select("conv_id", "turn", generate.overlap(F.col("query"), F.col("text")).alias("overlap"))


@query(
    "SELECT item_id, 'Context:' || chr(10) || '[1] s — t (u)' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM benchmark"
)
def prompts(spark, d):
    b = table(spark, d, "benchmark")
    chunk = F.struct(F.lit("s").alias("scheme_name"), F.lit("t").alias("section"), F.lit("u").alias("source_url"), "text")
    built_ = generate.build_prompt(F.col("text"), F.array(chunk))
    return b.select("item_id", F.get(built_, F.lit(1))["content"].alias("prompt"))


URL1, URL2 = "https://pages.example/one", "https://pages.example/two"
CONTEXT = (("The expense ratio is 1.04% for this plan. The exit load is 1% within one year.", "Fees", "One", URL1), ("The lock-in is 3 years. Minimum is ₹500.", "Terms", "Two", URL2))
STAMP = " Last updated from sources: 2026-01-31"
#: Raw text, and the kind, text and actions that must come of it.
ENFORCED = (
    (f"Certainly! The expense ratio is 1.04%. Source: {URL1}", "factual", f"The expense ratio is 1.04%. Source: {URL1}", "stripped_filler"),
    (f"The ratio is 1.04% {URL1}/", "factual", f"The ratio is 1.04% {URL1}/", ""),
    ("The ratio is 1.04%.", "not_found", None, "fail_closed_no_citation"),
    ("The ratio is 1.04%. https://elsewhere.example/x", "not_found", None, "dropped_unverified_urls:1|fail_closed_no_citation"),
    (f"A b. C d. E f. G h. {URL1}", "factual", f"A b. C d. G h. {URL1}", "truncated_to_3_sentences"),
    (f"The lock-in is 3 years. It costs ₹700 yearly. {URL2}", "factual", f"The lock-in is 3 years. It costs yearly. {URL2}", "dropped_unsupported_number:₹700"),
    (f"The lock-in is 3 years. The ratio is 9.99%. {URL2}", "factual", f"The lock-in is 3 years. {URL2}", "dropped_unsupported_number:9.99%|dropped_mangled_sentence"),
    ("The lock-in is 3 years [2].", "factual", f"The lock-in is 3 years {URL2}.", "resolved_chunk_markers:2"),
    (f"The ratio is 1.04 %. See {URL1} and {URL2}", "factual", f"The ratio is 1.04 %. See {URL1}", "reduced_to_one_citation:1"),
    ("", "not_found", None, "fail_closed_no_citation"),
    ("?", "not_found", None, "fail_closed_no_citation"),
    (f"the load is 1%. {URL1}", "factual", f"Load is 1%. {URL1}", ""),
)


def enforce_cases(spark, d):
    rows = spark.createDataFrame([(k, r[0]) for k, r in enumerate(ENFORCED)], "query_id int, raw string")
    chunks = F.array(
        *(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, ("text", "section", "scheme_name", "source_url"), strict=True))) for c in CONTEXT)
    )
    done = enforce.enforce(rows.withColumn("chunks", chunks).withColumn("max_fetched_at", F.lit("2026-01-31")))
    return done.select("query_id", "kind", "text", F.array_join("actions", "|").alias("actions"))


@query(
    "SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations) WHERE nth <= 3"
)
def session_last_turns(spark, d):
    rows = sessions.last_turns(table(spark, d, "conversations"), 3, "conv_id", "turn")
    return rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


def _golden_answers(spark) -> DataFrame:
    """Answers of the guard alone: refusals, and NOT_FOUND for the rest."""
    rows = spark.createDataFrame([(k, q) for k, (q, _, _) in enumerate(GOLDEN)], "query_id bigint, query string")
    aliases = spark.createDataFrame(ALIASES, "scheme_id string, alias string")
    manifest = spark.createDataFrame(
        [(s, f"{s} scheme", f"https://pages.example/{s}") for s in dict.fromkeys(a for a, _ in ALIASES)],
        "scheme_id string, scheme_name string, url string",
    )
    kept = rows.withColumn("raw_query", F.col("query"))
    guarded = answers.guarded(kept, aliases).withColumn("max_fetched_at", F.lit("2026-01-31")).withColumn("corpus_fingerprint", F.lit("f"))
    refused = answers.refusals(guarded, manifest)
    rest = guarded.where("guard.action = 'answer'").withColumn("max_similarity", F.lit(0.0))
    return refused.unionByName(answers.not_found(rest, manifest))


_SETS = {"refuse_advice": "advice", "refuse_pii": "pii", "refuse_performance": "performance", "answer": "factual"}


def eval_gates(spark, d):
    sets = F.create_map(*(F.lit(x) for kv in _SETS.items() for x in kv))
    done = _golden_answers(spark).withColumn("set", F.element_at(sets, F.col("guard.action")))
    return evaluate.gates(done, [URL1])


@query()
def answer_batch(spark, d):
    """Benchmark items asked of the chunks of all documents."""
    # Stands for the stored corpus: read several times, made once.
    chunks = durable.durable(ingest.embedded(chunking.chunk_documents(built(spark, d))), "answer-chunks")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    manifest = spark.createDataFrame([("large", "Large", URL1)], "scheme_id string, scheme_name string, url string")
    aliases = spark.createDataFrame(ALIASES, "scheme_id string, alias string")
    done = answers.answer(asked, chunks, manifest, aliases)
    return done.select("query_id", "kind", "text", "generation_mode", F.array_join("actions", "|").alias("actions"), tables.answer_payload().alias("payload"))


@query(
    "SELECT time_bucket(INTERVAL 5 minutes, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
)
def event_window_counts(spark, d):
    """The streaming aggregation over the table at rest."""
    rows = event_windows(table(spark, d, "events"))
    return rows.select("start", "event_type", "n", F.round("total", 4).alias("total"))

