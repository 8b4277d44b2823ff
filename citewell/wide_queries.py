"""Registered queries that run over whole tables what small cases alone would not show:
lines, aliases, repairs, enforcement, outcomes, numbering, and files written and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.config import Settings
from citewell.fold_queries import _ASKED, VALUE_ONLY, asked_documents, sql_pairs, sql_stripped
from citewell.functions import guard, text
from citewell.operators import chunking, durable, enforce, generate, retrieve, sections, store
from citewell.operators.encode import encode
from citewell.plans import answer as answers
from citewell.plans import evaluate
from citewell.queries import (
    _CHUNK_SQL,
    _DISTINCT,
    LINES,
    NEWLINE,
    STAMP,
    built,
    dealt,
    documents_as_chunks,
    documents_as_pages,
    query,
    sql_header,
    sql_lines,
    sql_sentences,
    sql_url,
    sql_ws,
    table,
    vectors,
)
from citewell.sources import tables

DAY = "2026-01-31"

# Lines --------------------------------------------------------------------------------


@query(
    rf"""
WITH l AS (
  SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (
    SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{LINES}') || ['Rs. ' || doc_id, '₹ ' || doc_id || '.5%', '+' || doc_id || ',000', 'Rating ' || doc_id] AS xs FROM documents)
)
SELECT doc_id, (i - 1)::INT AS i, NOT regexp_matches(x, '\p{{Nd}}') AS bare_label,
  bare <> '' AND NOT contains(replace(replace(replace(bare, '₹', ''), 'Rs.', ''), 'rs.', ''), ' ') AND regexp_matches(bare, '{VALUE_ONLY}') AS value_only,
  TRY_CAST(regexp_replace(x, '[^0-9.]', '', 'g') AS DOUBLE) AS amount,
  sha256('Last updated from sources: ' || coalesce(nullif(x, ''), 'unknown')) AS stamp
FROM (SELECT *, {sql_stripped("x")} AS bare FROM l)
"""
)
def line_shapes(spark, d):
    """Every line of every document, and figures made of its id."""
    i = F.col("doc_id").cast("string")
    figures = F.array(F.concat(F.lit("Rs. "), i), F.concat(F.lit("₹ "), i, F.lit(".5%")), F.concat(F.lit("+"), i, F.lit(",000")), F.concat(F.lit("Rating "), i))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.concat(text.split_lines("text"), figures)).alias("i", "x"))
    x = F.col("x")
    return lines.select(
        "doc_id", "i", text.is_bare_label(x).alias("bare_label"), text.is_value_only(x).alias("value_only"), text.amount(x).alias("amount"),
        F.sha2(text.freshness_line(F.nullif(x, F.lit(""))), 256).alias("stamp"),
    )


@query("SELECT doc_id, sha256(trim(coalesce(text, '') || ' ')) AS body FROM documents")
def stamp_removed(spark, d):
    """A text with a stamp behind it, without the stamp."""
    stamped = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), text.freshness_line(F.lit(DAY)))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.without_freshness(stamped), 256).alias("body"))


#: Scheme and alias: words that documents have, some of them within one another.
NAMED = (
    ("a", "the"), ("a", "of the"), ("b", "nicht"), ("b", "und die"), ("c", "que"), ("c", "de la"), ("d", "les"), ("d", "et"), ("e", "token ="),
    ("f", "licensed under"), ("f", "licensed"), ("g", "para"), ("h", "!!"),
)
_ENDS = r"\pL\pM\p{Nd}\p{Pc}"
_HITS = ", ".join(
    "CASE WHEN " + " OR ".join(f"regexp_matches(t, '(^|[^{_ENDS}]){a.replace('!', '[!]')}($|[^{_ENDS}])')" for s, a in NAMED if s == one) + f" THEN '{one}' END"
    for one in dict.fromkeys(s for s, _ in NAMED)
)
_ALIAS_SQL = f"""
WITH h AS (SELECT doc_id, list_filter([{_HITS}], lambda s: s IS NOT NULL) AS s FROM (SELECT doc_id, lower(text) AS t FROM documents))
SELECT doc_id, CASE WHEN len(s) = 1 THEN s[1] END AS scheme_id FROM h
"""


def _resolved(spark, d, few: int) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("query"))
    named = retrieve.resolve_scheme(rows, spark.createDataFrame(NAMED, "scheme_id string, alias string"), few=few)
    return named.select("doc_id", "scheme_id")


@query(_ALIAS_SQL)
def alias_resolution(spark, d):
    """Documents as questions, aliases as patterns."""
    return _resolved(spark, d, retrieve.FEW)


@query(_ALIAS_SQL)
def alias_lookup(spark, d):
    """The same by the join that long lists of aliases take."""
    return _resolved(spark, d, 0)


# Documents -----------------------------------------------------------------------------


@query(
    f"""
WITH v AS (
  SELECT doc_id, 100000 + 7 * doc_id AS house, coalesce(text, '') AS t FROM documents
), p AS (
  SELECT doc_id, t, CASE doc_id % 4 WHEN 0 THEN '' || house WHEN 1 THEN (house + 1) || '.0' WHEN 2 THEN '' || (3 * house) ELSE '₹' || doc_id END || ' Cr' AS said,
         CASE doc_id % 4 WHEN 2 THEN (3 * house) || ' Cr' ELSE '₹' || doc_id || ' Cr' END AS stays FROM v
)
SELECT doc_id::VARCHAR AS scheme_id, sha256({sql_lines("'Asset Under Management(AUM) of ' || stays || ' today' || chr(10) || t")}) AS prose,
       said <> stays AS changed FROM p
"""
)
def figure_repair(spark, d):
    """Each document with its scheme's and its house's figure ahead, and prose that gives
    the house's, nearly the house's, another, or the scheme's."""
    house, i = F.lit(100000) + 7 * F.col("doc_id"), F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    said = F.concat(
        F.when(kind == 0, house.cast("string")).when(kind == 1, F.concat((house + 1).cast("string"), F.lit(".0"))).when(kind == 2, (3 * house).cast("string"))
        .otherwise(F.concat(F.lit("₹"), i)),
        F.lit(" Cr"),
    )
    prose = F.concat(F.lit("Asset Under Management(AUM) of "), said, F.lit(" today\n"), F.coalesce("text", F.lit("")))
    part = lambda t, k: F.struct(
        F.lit("s").alias("section_title"), F.lit(2).alias("heading_level"), t.alias("text"), F.lit(False).alias("is_table"), F.lit(k).alias("order")
    )
    parts = F.array(part(F.concat(F.lit("Fund size (AUM) ₹"), i, F.lit(" Cr")), 0), part(F.concat(F.lit("Total AUM ₹"), house.cast("string"), F.lit(" Cr")), 1), part(prose, 2))
    docs = dealt(table(spark, d, "documents"))
    pages = docs.select(i.alias("scheme_id"), *(F.lit("x").alias(n) for n in ("scheme_name", "category", "plan", "final_url", "extraction_mode")), parts.alias("sections"))
    after = F.get("sections", F.lit(2))["text"]
    done = sections.build_documents(pages, F.lit(DAY)).select("scheme_id", after.alias("after"))
    before = docs.select(i.alias("scheme_id"), text.normalize_lines(prose).alias("before"))
    return done.join(before, "scheme_id").select("scheme_id", F.sha2("after", 256).alias("prose"), (F.col("after") != F.col("before")).alias("changed"))


@query(
    f"""
WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '{LINES}'), lambda x: {sql_ws("x")}) AS xs FROM documents),
k AS (SELECT doc_id, list_filter(xs, lambda x: x <> '') AS ks FROM l)
SELECT doc_id::VARCHAR AS scheme_id, (generate_subscripts(ks, 1) - 1)::INT AS "order", unnest(list_transform(ks, lambda x: sha256(x))) AS text_sha256 FROM k
"""
)
def section_renumber(spark, d):
    """Lines as sections: empty ones go, and the rest are numbered anew."""
    docs = documents_as_pages(spark, d).withColumn(
        "sections",
        F.transform(
            text.split_lines(F.get("sections", F.lit(0))["text"]),
            lambda x, i: F.struct(F.lit("").alias("section_title"), F.lit(2).alias("heading_level"), x.alias("text"), F.lit(False).alias("is_table"), (i * 3).alias("order")),
        ),
    )
    rows = sections.build_documents(docs, F.lit(DAY)).select("scheme_id", F.explode("sections").alias("s"))
    return rows.select("scheme_id", "s.order", F.sha2("s.text", 256).alias("text_sha256"))


@query(
    f"""
WITH l AS (SELECT doc_id, {sql_lines("coalesce(text, '')")} AS body FROM documents),
f AS ({sql_pairs("(SELECT doc_id, coalesce(text, '') AS t FROM documents)", "doc_id")})
SELECT doc_id::VARCHAR AS scheme_id, (body <> '')::INT AS n_sections, (body <> '' AND pairs >= 3)::INT AS n_tables, length(body)::INT AS n_chars
FROM l JOIN f USING (doc_id)
"""
)
def ingest_stats(spark, d):
    return sections.document_stats(built(spark, d))


@query(
    f"""
WITH l AS (SELECT doc_id, source, lang, {sql_lines("text")} AS body FROM documents),
s AS (SELECT doc_id, source, lang, string_split(body, {NEWLINE}) AS ls FROM l WHERE body <> ''),
u AS (SELECT doc_id, source, lang, unnest(ls) AS body, (generate_subscripts(ls, 1) - 1)::INT AS k FROM s)
SELECT doc_id::VARCHAR AS scheme_id, k AS chunk_index, sha256('https://pages.example/' || doc_id || '|' || (k * 2) || '|' || k || '|' || body)[:16] AS chunk_id,
       sha256(body) AS content_sha256, sha256({sql_header("'L' || k")} || chr(10) || body) AS embed_sha256
FROM u
"""
)
def chunk_index(spark, d):
    """Lines as pieces, numbered through their document."""
    lines = F.split(F.get("sections", F.lit(0))["text"], "\n", -1)
    piece = lambda x, i: F.struct(F.concat(F.lit("L"), i.cast("string")).alias("section"), (i * 2).alias("order"), F.lit(False).alias("is_table"), x.alias("body"))
    rows = chunking.number_pieces(built(spark, d).withColumn("pieces", F.transform(lines, piece)))
    return rows.select("scheme_id", "chunk_index", "chunk_id", "content_sha256", F.sha2("embed_text", 256).alias("embed_sha256"))


@query(
    f"""
WITH {_CHUNK_SQL}, f AS ({sql_pairs("(SELECT doc_id, coalesce(text, '') AS t FROM documents)", "doc_id")})
SELECT chunk_id, doc_id::VARCHAR AS scheme_id, source AS scheme_name, lang AS category, 'Direct' AS plan, 'Section ' || lang AS section,
       'https://pages.example/' || doc_id AS source_url, '{DAY}' AS fetched_at, 0::INT AS chunk_index,
       CASE WHEN pairs >= 3 THEN 'true' ELSE 'false' END AS is_table, sha256(body) AS content_sha256 FROM e JOIN f USING (doc_id)
"""
)
def flat_metadata(spark, d):
    return store.flat_metadata(documents_as_chunks(spark, d))


@query(
    f"""
WITH {_CHUNK_SQL}, v AS (SELECT *, doc_id % 6 AS k FROM e WHERE body <> '')
SELECT chunk_id, 'over_limit' AS violation FROM v WHERE ceil((length(embed_text) - CASE k WHEN 1 THEN 1 ELSE 0 END) / 4) > 240
UNION ALL SELECT chunk_id, 'no_header' FROM v WHERE k = 1
UNION ALL SELECT chunk_id, 'header_leak' FROM v WHERE k = 2 OR k <> 5 AND contains(body, '[Scheme:')
UNION ALL SELECT chunk_id, 'empty_scheme_name' FROM v WHERE coalesce({sql_stripped("source")}, '') = ''
UNION ALL SELECT chunk_id, 'empty_category' FROM v WHERE coalesce({sql_stripped("lang")}, '') = ''
UNION ALL SELECT chunk_id, 'empty_plan' FROM v WHERE k = 3
UNION ALL SELECT chunk_id, 'empty_section' FROM v WHERE k = 4
UNION ALL SELECT chunk_id, 'empty_display_text' FROM v WHERE k = 5
"""
)
def chunk_violations(spark, d):
    """Chunks as they should be, and with one thing wrong by doc_id."""
    k = F.col("scheme_id").cast("bigint") % 6
    wrong = {
        "embed_text": F.when(k == 1, F.substr("embed_text", F.lit(2))), "display_text": F.when(k == 2, F.concat(F.lit("x [Scheme: y"), "display_text")).when(k == 5, " \n"),
        "plan": F.when(k == 3, F.lit(None).cast("string")), "section": F.when(k == 4, " "),
    }
    chunks = documents_as_chunks(spark, d)
    broken = {"plan": F.when(k == 3, F.lit(None)).otherwise(F.col("plan"))}
    return chunking.violations(chunks.withColumns({c: broken.get(c, F.coalesce(x, F.col(c))) for c, x in wrong.items()}))


# Citations ------------------------------------------------------------------------------


@query(f"SELECT page_id, CASE WHEN contains(url, 'example.com') THEN 'factual' ELSE 'not_found' END AS kind, CASE WHEN contains(url, 'example.com') THEN {sql_url('url')} END AS cited FROM pages")
def citation_whitelist(spark, d):
    """An answer that cites each page, where only pages of one site were retrieved."""
    url = F.when(F.contains("url", F.lit("example.com")), F.col("url")).otherwise("https://none.example/")
    chunk = F.struct(F.lit("A text.").alias("text"), F.lit("s").alias("section"), F.lit("n").alias("scheme_name"), url.alias("source_url"))
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("As the page says. Source: "), "url").alias("raw"), F.array(chunk).alias("chunks"), F.lit(DAY).alias("max_fetched_at"))
    done = enforce.enforce(rows)
    cited = F.when(F.size("citations") > 0, text.normalize_url(F.get("citations", F.lit(0))["url"]))
    return done.select("page_id", "kind", cited.alias("cited"))


@query(f"SELECT page_id, CASE WHEN {sql_url("url || '/'")} = {sql_url('url')} THEN url || '/' ELSE url END AS url, CASE WHEN {sql_url("url || '/'")} = {sql_url('url')} THEN 'first' ELSE 'second' END AS section FROM pages")
def citation_lookup(spark, d):
    """The first chunk with a page's url, however it is spelt."""
    chunk = lambda u, s: F.struct(u.alias("source_url"), F.lit(s).alias("section"), F.lit("n").alias("scheme_name"))
    chunks = F.array(chunk(F.lit("https://other.example/x"), "none"), chunk(F.concat("url", F.lit("/")), "first"), chunk(F.col("url"), "second"))
    found = table(spark, d, "pages").select("page_id", enforce.citation_from(F.col("url"), chunks).alias("c"))
    return found.select("page_id", "c.url", "c.section")


@query("WITH m AS (SELECT DISTINCT source, 'https://pages.example/' || source AS url FROM documents WHERE source <> 'src1') SELECT doc_id, url AS page_url FROM documents LEFT JOIN m USING (source)")
def scheme_page(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("scheme_id"))
    manifest = docs.where("scheme_id <> 'src1'").select("scheme_id").distinct().withColumn("url", F.concat(F.lit("https://pages.example/"), "scheme_id"))
    return answers.scheme_page(docs, manifest).select("doc_id", "page_url")


# Answers --------------------------------------------------------------------------------

#: By doc_id: what a writer might give, and what must come of it. D: its id, U: its url.
WRITTEN = (
    ("Certainly! The ratio of item D is D.5% here. Source: U", "factual", "The ratio of item D is D.5% here. Source: U", "stripped_filler"),
    ("The ratio of item D is D.5% here.", "not_found", None, "fail_closed_no_citation"),
    ("The ratio is D.5% here. https://elsewhere.example/x", "not_found", None, "dropped_unverified_urls:1|fail_closed_no_citation"),
    ("A b. C d. E f. G h. U", "factual", "A b. C d. G h. U", "truncated_to_3_sentences"),
    ("The ratio is D.5% now. It costs ₹7777777 yearly. U", "factual", "The ratio is D.5% now. It costs yearly. U", "dropped_unsupported_number:₹7777777"),
    ("The ratio is D.5% [1].", "factual", "The ratio is D.5% U.", "resolved_chunk_markers:1"),
    ("the load is D.5%. See U and https://pages.example/other", "factual", "Load is D.5%. See U", "dropped_unverified_urls:1|reduced_to_one_citation:1"),
    ("The ratio is D.5%【1】.", "factual", "The ratio is D.5% U.", "resolved_chunk_markers:1"),
    ("The ratio is D.5% here. It was about ₹7777777. U", "factual", "The ratio is D.5% here. U", "dropped_unsupported_number:₹7777777|dropped_mangled_sentence"),
    ("The ratio is D.5% here. It was about ₹7777777 (U).", "factual", "The ratio is D.5% here. Source: U",
     "dropped_unsupported_number:₹7777777|dropped_mangled_sentence|restored_citation_after_numeric_audit"),
    ("", "not_found", None, "fail_closed_no_citation"),
)
_FILLED = "replace(replace({}, 'D', doc_id::VARCHAR), 'U', 'https://pages.example/' || doc_id % 7)".format


def _pick(at: int) -> str:
    return "[" + ", ".join("NULL" if w[at] is None else "'" + w[at] + "'" for w in WRITTEN) + f"][1 + doc_id % {len(WRITTEN)}]"


_ENFORCED = f"""
w AS (SELECT doc_id, {_pick(1)} AS kind, {_pick(3)} AS actions, coalesce({_FILLED(_pick(2))}, '{enforce.NOT_FOUND_TEXT.replace("'", "''")}') || '{STAMP}' AS text,
  CASE WHEN {_pick(1)} = 'factual' THEN 'https://pages.example/' || doc_id % 7 END AS cited FROM documents)
"""


def enforced(spark, d) -> DataFrame:
    value = lambda at: F.get(F.array(*(F.lit(w[at]) for w in WRITTEN)), (F.col("doc_id") % len(WRITTEN)).cast("int"))
    i, url = F.col("doc_id").cast("string"), F.concat(F.lit("https://pages.example/"), (F.col("doc_id") % 7).cast("string"))
    raw = F.replace(F.replace(value(0), F.lit("D"), i), F.lit("U"), url)
    said = F.concat(F.lit("The ratio of item "), i, F.lit(" is "), i, F.lit(".5% here. The load is "), i, F.lit(".5%.\n"), F.coalesce("text", F.lit("")))
    chunk = F.struct(said.alias("text"), F.concat(F.lit("part "), "lang").alias("section"), F.col("source").alias("scheme_name"), url.alias("source_url"))
    rows = dealt(table(spark, d, "documents")).select("doc_id", raw.alias("raw"), F.array(chunk).alias("chunks"), F.lit(DAY).alias("max_fetched_at"))
    return enforce.enforce(rows)


@query(
    f"WITH {_ENFORCED} SELECT doc_id, kind, text, actions, cited, CASE WHEN cited IS NOT NULL THEN 'part ' || lang END AS section, "
    "CASE WHEN cited IS NOT NULL THEN source END AS scheme_name FROM w JOIN documents d USING (doc_id)".replace("text, actions", "w.text, actions")
)
def enforce_cases(spark, d):
    """Every document as the only source of an answer about it."""
    c = F.get("citations", F.lit(0))
    return enforced(spark, d).select("doc_id", "kind", "text", F.array_join("actions", "|").alias("actions"), c["url"].alias("cited"), c["section"].alias("section"), c["scheme_name"].alias("scheme_name"))


def guard_answers(spark, d) -> DataFrame:
    """Answers of the guard alone to every document after a question: refusals, and
    NOT_FOUND for the rest."""
    rows = asked_documents(spark, d).withColumnRenamed("doc_id", "query_id")
    aliases = spark.createDataFrame([("large", "large cap")], "scheme_id string, alias string")
    manifest = spark.createDataFrame([("large", "Large", "https://pages.example/large")], "scheme_id string, scheme_name string, url string")
    guarded = answers.guarded(rows, aliases).withColumn("max_fetched_at", F.lit(DAY)).withColumn("corpus_fingerprint", F.lit("f"))
    return answers.unsearched(guarded.withColumn("max_similarity", F.lit(0.0)), manifest)


def _said(action: str) -> str:
    return "'" + answers.TEXTS[action].replace("'", "''") + STAMP + "'"


_REFUSED = f"""
{_ASKED}, z AS (
  SELECT doc_id AS query_id, CASE WHEN action = 'answer' THEN 'not_found' ELSE 'refusal' END AS kind,
    CASE action WHEN 'refuse_pii' THEN {_said(guard.REFUSE_PII)} WHEN 'refuse_advice' THEN {_said(guard.REFUSE_ADVICE)}
      WHEN 'refuse_performance' THEN {_said(guard.REFUSE_PERFORMANCE)} ELSE {_said(guard.NOT_IN_SOURCES)} END AS text,
    CASE WHEN action = 'refuse_pii' THEN NULL ELSE '{answers.EDUCATION_URL}' END AS cited,
    CASE WHEN action = 'answer' THEN 'retrieval_empty' ELSE 'refused:' || action || '|retrieval_skipped' END AS actions, action FROM g
)"""


@query(f"WITH {_REFUSED} SELECT query_id, kind, text, cited, actions, '{DAY}' AS last_updated, 'static' AS generation_mode FROM z")
def static_answers(spark, d):
    done = guard_answers(spark, d)
    return done.select("query_id", "kind", "text", F.get("citations", F.lit(0))["url"].alias("cited"), F.array_join("actions", "|").alias("actions"), "last_updated", "generation_mode")


_SETS = {"refuse_advice": "advice", "refuse_pii": "pii", "refuse_performance": "performance", "answer": "offcorpus"}


def judged(spark, d) -> DataFrame:
    """Both kinds of answers, with the set that each question is of."""
    sets = F.create_map(*(F.lit(x) for kv in _SETS.items() for x in kv))
    guarded = guard_answers(spark, d).select(F.element_at(sets, F.col("guard.action")).alias("set"), "kind", "text", "citations")
    written = enforced(spark, d).select(F.lit("factual").alias("set"), "kind", "text", "citations")
    return guarded.unionByName(written)


_JUDGED = f"""
{_REFUSED}, {_ENFORCED}, j AS (
  SELECT CASE action WHEN 'refuse_advice' THEN 'advice' WHEN 'refuse_pii' THEN 'pii' WHEN 'refuse_performance' THEN 'performance' ELSE 'offcorpus' END AS set, kind, text, cited FROM z
  UNION ALL SELECT 'factual', kind, text, cited FROM w
)"""


@query(f"WITH {_JUDGED} SELECT set, kind, count(*) AS n FROM j GROUP BY 1, 2")
def turn_outcomes(spark, d):
    return evaluate.outcomes(judged(spark, d))


_GATES = f"""
r(gate, least, n, passed) AS (
  SELECT 'AC1', 1.0, count(*) FILTER (kind = 'factual'), count(*) FILTER (kind = 'factual' AND cited NOT LIKE '%/5' AND cited NOT LIKE '%/6') FROM j
  UNION ALL SELECT 'AC2', 1.0, count(*), count(*) FROM j
  UNION ALL SELECT 'AC3', 1.0, count(*) FILTER (kind = 'factual'),
    count(*) FILTER (kind = 'factual' AND len({sql_sentences("trim(split_part(text, 'Last updated from sources:', 1))")}) <= 4) FROM j
  UNION ALL SELECT 'AC4', 1.0, count(*) FILTER (set = 'advice'), count(*) FILTER (set = 'advice' AND kind = 'refusal') FROM j
  UNION ALL SELECT 'AC5', 1.0, count(*) FILTER (set = 'pii'), count(*) FILTER (set = 'pii' AND kind = 'refusal') FROM j
  UNION ALL SELECT 'AC6', 1.0, count(*) FILTER (set = 'performance'), count(*) FILTER (set = 'performance' AND kind = 'refusal' AND NOT regexp_matches(text, '[0-9] *%')) FROM j
  UNION ALL SELECT 'AC7', 1.0, count(*) FILTER (kind <> 'error'), count(*) FILTER (kind <> 'error' AND contains(text, 'Last updated from sources:')) FROM j
  UNION ALL SELECT 'AC8', 0.9, count(*) FILTER (set = 'factual'), count(*) FILTER (set = 'factual' AND kind = 'factual') FROM j
  UNION ALL SELECT 'AC9', 1.0, count(*) FILTER (set = 'offcorpus'), count(*) FILTER (set = 'offcorpus' AND kind = 'not_found') FROM j
)
SELECT gate, n, passed, CASE WHEN n > 0 THEN passed / n END AS rate, coalesce(passed / nullif(n, 0), 1) >= least AS ok FROM r
"""


@query(f"WITH {_JUDGED}, {_GATES}")
def eval_gates(spark, d):
    return evaluate.gates(judged(spark, d), [f"https://pages.example/{k}" for k in range(5)])


@query(
    "SELECT item_id, ({} + length('Context:' || chr(10) || '[1] s — t (u)' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || text))::INT AS chars FROM benchmark".format(
        len(generate.SYSTEM)
    )
)
def prompt_sizes(spark, d):
    b = table(spark, d, "benchmark")
    chunk = F.struct(F.lit("s").alias("scheme_name"), F.lit("t").alias("section"), F.lit("u").alias("source_url"), "text")
    return b.select("item_id", generate.prompt_chars(generate.build_prompt(F.col("text"), F.array(chunk))).alias("chars"))


# Search ---------------------------------------------------------------------------------


def letters(dimensions: int):
    """A model for the encoder's slot that SQL can follow: counts of letters."""

    def load():
        import numpy as np

        return lambda texts: np.array([[t.count(chr(97 + k)) for k in range(dimensions)] for t in texts], dtype=float)

    return load


@query(
    "WITH c AS (SELECT doc_id, list_transform(range(0, 26), lambda k: length(text) - length(replace(text, chr((97 + k)::INT), ''))) AS v FROM documents) "
    "SELECT doc_id, list_transform(v, lambda x: round(x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-9), 2)) AS embedding FROM c"
)
def model_encode(spark, d):
    """A given model in place of hashing: unit rows, in double precision, as many of their
    numbers (7/40) lie between two that are rounded to."""
    rows = encode(table(spark, d, "documents").select("doc_id", "text"), "text", load=letters(26), dimensions=26, double=True)
    # The double itself is rounded, not its shortest decimal form.
    return rows.select("doc_id", F.transform("embedding", lambda x: F.round(x * 100) / 100).alias("embedding"))


_RETRIEVED = _DISTINCT.replace(" AND q.vec_id <> c.vec_id", "").replace("rank <= 24)", "rank <= 24 AND similarity >= 0.25)")


@query(
    f"""
WITH RECURSIVE {_RETRIEVED},
c AS (SELECT u.query_id, u.vec_id, u.similarity, row_number() OVER (PARTITION BY u.query_id ORDER BY u.rank) AS place,
        count(*) OVER (PARTITION BY u.query_id) AS n, e.embedding::DOUBLE[] AS v FROM u JOIN embeddings e USING (vec_id)),
p AS (SELECT a.query_id, a.place AS i, b.place AS j, list_dot_product(a.v, b.v) AS alike FROM c a JOIN c b USING (query_id)),
r AS (
  SELECT query_id, 1 AS k, [place] AS sel, place AS last, similarity AS score FROM c WHERE place = 1 AND n > 3
  UNION ALL
  SELECT query_id, k + 1, list_append(sel, (-b.at)::BIGINT), (-b.at)::BIGINT, b.score
  FROM (
    SELECT query_id, k, sel, max({{'score': score, 'at': -place}}) AS b
    FROM (
      SELECT r.query_id, r.k, r.sel, c.place, 0.7 * c.similarity - (1.0 - 0.7) * max(p.alike) AS score
      FROM r JOIN c ON c.query_id = r.query_id AND NOT list_contains(r.sel, c.place)
             JOIN p ON p.query_id = r.query_id AND p.i = c.place AND list_contains(r.sel, p.j)
      WHERE r.k < 3 GROUP BY r.query_id, r.k, r.sel, c.place, c.similarity
    ) GROUP BY query_id, k, sel
  )
)
SELECT r.query_id, c.vec_id, r.k::INT AS rank, round(r.score, 6) AS mmr_score FROM r JOIN c ON c.query_id = r.query_id AND c.place = r.last
UNION ALL
SELECT query_id, vec_id, place::INT, round(similarity, 6) FROM c WHERE n <= 3
"""
)
def retrieve_vectors(spark, d):
    """The whole of retrieval over the vectors: search, floor, sections, reranking."""
    rows, asked = vectors(spark, d)
    blank = lambda *names: (F.lit("x").alias(n) for n in names)
    corpus = rows.select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("section"), "embedding", F.col("embedding").alias("body_embedding"),
        *blank("scheme_id", "scheme_name", "source_url", "fetched_at", "display_text"),
    )
    found = retrieve.retrieve(asked.select("query_id", "embedding", F.lit(None).cast("string").alias("scheme_id")), corpus, Settings(top_k=3))
    return found.select("query_id", F.col("chunk_id").alias("vec_id"), "rank", F.round("mmr_score", 6).alias("mmr_score"))


@query("SELECT count(*) = 0 AS empty, max(nullif(lang, '')) AS max_fetched_at, true AS none_is_empty FROM documents")
def corpus_facts(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("fetched_at"))
    row = (store.is_empty(docs), store.max_fetched_at(docs), store.is_empty(None))
    return spark.createDataFrame([row], "empty boolean, max_fetched_at string, none_is_empty boolean")


# Files ------------------------------------------------------------------------------------


def _text_file(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """Lines as the files of a folder, in order."""
    path = durable.place(spark, name)
    lines.write.text(path)
    return path


@query("SELECT page_id::VARCHAR AS scheme_id, 'Page, \"' || page_id || '\"' AS scheme_name, 'c' AS category, 'p' AS plan, trim(url) AS url FROM pages")
def manifest_scan(spark, d):
    """Pages written as a manifest and read back."""
    rows = table(spark, d, "pages").select(
        F.concat(F.lit(" "), F.col("page_id").cast("string"), F.lit(" ")).alias("scheme_id"),
        F.concat(F.lit('Page, "'), F.col("page_id").cast("string"), F.lit('"')).alias("scheme_name"),
        F.lit("c").alias("category"), F.lit("p").alias("plan"), "url",
    )
    path = durable.place(spark, "manifest")
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.read_sources(spark, path)


@query("SELECT page_id % 50 || '' AS scheme_id, arg_max('n' || page_id, page_id) AS scheme_name, arg_max(url, page_id) AS url FROM pages WHERE page_id % 7 <> 0 GROUP BY 1")
def source_index(spark, d):
    """A manifest with repeated ids and missing urls: the last whole row of an id counts."""
    rows = table(spark, d, "pages").orderBy("page_id").select(
        (F.col("page_id") % 50).cast("string").alias("scheme_id"), F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("scheme_name"),
        F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("url"),
    )
    path = durable.place(spark, "index")
    rows.write.csv(path, header=True, escape='"')
    return tables.source_index(spark, path)


@query("SELECT source AS scheme_id, lower(lang || ' ' || source) AS alias FROM documents GROUP BY lang, source")
def alias_file(spark, d):
    """A JSON object of lists, written and read back."""
    by = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set(F.upper(F.concat_ws(" ", "lang", "source")))).alias("names"))
    one = by.agg(F.map_from_entries(F.collect_list(F.struct("source", "names"))).alias("m")).select(F.to_json("m").alias("value"))
    path = _text_file(spark, one, "aliases")
    return tables.read_aliases(spark, path)


@query(
    f"WITH {_CHUNK_SQL}, f AS ({sql_pairs('(SELECT doc_id, coalesce(text, chr(10)) AS t FROM documents)', 'doc_id')}) "
    "SELECT doc_id::VARCHAR AS scheme_id, source AS scheme_name, 'Section ' || lang AS section_title, body AS text, pairs >= 3 AS is_table FROM e JOIN f USING (doc_id)"
)
def documents_file(spark, d):
    """Documents as lines of JSON and back."""
    path = durable.place(spark, "documents")
    tables.write_json(built(spark, d), path, ("scheme_id",))
    rows = tables.load_documents(spark, path).select("scheme_id", "scheme_name", F.explode("sections").alias("s"))
    return rows.select("scheme_id", "scheme_name", "s.section_title", "s.text", "s.is_table")


@query(f"WITH {_CHUNK_SQL} SELECT chunk_id, doc_id::VARCHAR AS scheme_id, 0::INT AS chunk_index, embed_text, body AS display_text FROM e")
def chunks_file(spark, d):
    """Chunks as lines of JSON and back."""
    path = durable.place(spark, "chunks")
    tables.write_json(documents_as_chunks(spark, d), path, ("scheme_id", "chunk_index"))
    return tables.load_chunks(spark, path).select("chunk_id", "scheme_id", "chunk_index", "embed_text", "display_text")


@query(
    "WITH l AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '  ' ELSE ' ' || url || ' ' END AS x FROM pages) "
    "SELECT (row_number() OVER (ORDER BY page_id) - 1)::BIGINT AS query_id, trim(x) AS query FROM l QUALIFY trim(x) <> ''"
)
def questions_file(spark, d):
    """A session of questions with blank lines, and what stands behind the word that ends it."""
    url = F.when(F.col("page_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    pages = table(spark, d, "pages").select(F.lit(0).alias("k"), "page_id", url.alias("value"))
    end = spark.createDataFrame([(1, 0, " Quit ")], pages.schema)
    rows = pages.unionByName(end).unionByName(pages.withColumn("k", F.lit(2)))
    return tables.read_questions(spark, _text_file(spark, rows.orderBy("k", "page_id").select("value"), "questions"))


@query(
    f"WITH {_REFUSED} SELECT query_id, kind, text, cited, 'refuse' = left(action, 6) AS refused, actions, "
    "'f' AS corpus_fingerprint FROM z".replace("action, 6", "z.action, 6")
)
def answers_file(spark, d):
    """Answers as lines of JSON, without the question, and what a reader finds in them."""
    done = guard_answers(spark, d).select("query_id", tables.answer_payload().alias("value"))
    path = durable.place(spark, "answers")
    done.write.json(path)
    schema = "kind string, text string, citations array<struct<url:string>>, guard_action string, postprocess_actions array<string>, corpus_fingerprint string"
    rows = spark.read.schema("query_id bigint, value string").json(path).select("query_id", F.from_json("value", schema).alias("a"))
    return rows.select(
        "query_id", "a.kind", "a.text", F.get("a.citations", F.lit(0))["url"].alias("cited"), F.startswith("a.guard_action", F.lit("refuse")).alias("refused"),
        F.array_join("a.postprocess_actions", "|").alias("actions"), "a.corpus_fingerprint",
    )
