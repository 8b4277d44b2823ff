"""Enforcement: what an answer must be, made so by expressions.

The order matters: openers go, chunk markers become urls, the text is cut to its
budget, one verified citation stays, figures that the context lacks go, the
citation is put back if that took it, and the date comes last, where the audit
can't delete it. A text without a verified citation fails closed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.config import Settings
from citewell.functions.text import (
    FRESHNESS,
    canonical_number,
    extract_numbers,
    extract_urls,
    freshness_line,
    let,
    looks_mangled,
    normalize_url,
    normalize_ws,
    split_sentences,
    strip,
    strip_number,
)

FACTUAL, NOT_FOUND, REFUSAL, ERROR = "factual", "not_found", "refusal", "error"
NOT_FOUND_TEXT = (
    "The pages at hand do not answer that. Try a factual question about one of the schemes they cover, or look at the "
    "linked page itself."
)
ACTIONS = "array<string>"
CITATION = "array<struct<url:string,section:string,scheme_name:string>>"

# Fillers that open an answer, stamps that a model writes itself, markers and links.
OPENERS = (
    r"sure(?:\s+thing)?|certainly|of\s+course|absolutely|i'?d\s+be\s+happy\s+to\s+help|happy\s+to\s+help|"
    r"as\s+an\s+ai(?:\s+language\s+model)?"
)
STAMP = FRESHNESS.replace(" ", r"\ ") + r"(?:\s*(?:<[^>\n]*>|\d{4}-\d{2}-\d{2}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}))?"
MARKER = r"[【\[]\s*(\d{1,3})\s*[】\]]"
LINK = r"[\[【［]([^\]】］]*)[\]】］]\((https?://[^)]+)\)"
DANGLING = r"[\s,;]*(?:\band also\b|\band\b|\balso\b|\bplus\b|\bor\b|\bsee\b)\s*\.?\s*$"
#: Stands for the citation while figures are audited.
MASK = "\x00cite\x00"


def strip_openers(raw: Column) -> Column:
    """struct<text, changed>"""
    text = F.coalesce(raw, F.lit(""))
    unstamped = strip(F.regexp_replace(F.regexp_replace(text, f"(?iU){STAMP}", " "), r"[ \t]{2,}", " "))
    opened = strip(F.regexp_replace(unstamped, rf"(?iU)^(?:\s*(?:{OPENERS})[\s,!.…—-]*)+", ""))

    def capital(x: Column) -> Column:
        bare = F.regexp_replace(x, r"(?iU)^(?:a|an|the)\b\s*", "")
        upper = let(bare, lambda b: F.concat(F.upper(F.substring(b, 1, 1)), F.substr(b, F.lit(2))))
        return F.when(x.rlike(r"^\p{Ll}"), strip(upper)).otherwise(x)

    return F.struct(let(opened, capital).alias("text"), ((unstamped != strip(text)) | (opened != unstamped)).alias("changed"))


def resolve_markers(text: Column, urls: Column) -> Column:
    """struct<text, markers>: ``[n]`` becomes the url of the n-th chunk, if the text
    has no url itself and there is such a chunk."""

    def of(both: Column) -> Column:
        def url(m: Column, i: Column) -> Column:
            n = F.regexp_extract(m, r"(\d+)", 1).cast("int")
            before = F.get(both["pieces"], i)
            gap = F.when((before == "") & (i == 0) | before.rlike(rf"(?U)\s$"), "").otherwise(" ")
            return F.when((n >= 1) & (n <= F.size(urls)), F.concat(gap, F.get(urls, n - 1))).otherwise(m)

        ends = F.transform(both["found"], url)
        joined = F.array_join(F.transform(both["pieces"], lambda p, i: F.concat(p, F.coalesce(F.get(ends, i), F.lit("")))), "")
        numbers = F.transform(both["found"], lambda m: F.regexp_extract(m, r"(\d+)", 1).cast("int"))
        known = F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(urls)))
        return F.struct(joined.alias("text"), known.alias("markers"))

    found = F.regexp_extract_all(text, F.lit(f"(?U){MARKER}"), F.lit(0))
    both = F.struct(found.alias("found"), F.split(text, f"(?U){MARKER}", -1).alias("pieces"))
    none = F.struct(text.alias("text"), F.array().cast("array<int>").alias("markers"))
    usable = (F.size(urls) > 0) & (F.size(extract_urls(text)) == 0)
    return F.when(usable, let(both, of)).otherwise(none)


def fit_budget(text: Column, budget: int, allowed: Column) -> Column:
    """struct<text, sentences>: the first sentences, the last of them given up for
    the first that holds a verified url, if that is further back."""

    def of(sentences: Column) -> Column:
        cites = lambda x: F.exists(extract_urls(x), lambda u: F.array_contains(allowed, normalize_url(u)))
        at = F.array_position(F.transform(sentences, cites), F.lit(True)).cast("int")
        near = F.array_join(F.slice(sentences, 1, budget), " ") if budget > 0 else F.lit("")
        head = F.slice(sentences, 1, budget - 1) if budget > 1 else F.array().cast("array<string>")
        far = F.array_join(F.concat(head, F.array(F.get(sentences, at - 1))), " ")
        cut = F.when(at > budget, far).otherwise(near)
        whole = F.size(sentences) <= budget
        return F.struct(F.when(whole & F.lit(budget >= 1), text).otherwise(strip(cut)).alias("text"), F.size(sentences).alias("sentences"))

    return let(split_sentences(text), of)


def keep_one_url(text: Column, keep: Column) -> Column:
    """struct<text, removed>: one occurrence of the kept url; other urls, and other
    spellings of it, go with what they leave dangling."""
    zero = lambda x: F.struct(x.alias("out"), F.lit(0).alias("removed"))

    def without(acc: Column, url: Column) -> Column:
        hit = F.contains(acc["out"], url) & (url != keep)
        return F.struct(
            F.when(hit, F.replace(acc["out"], url, F.lit(""))).otherwise(acc["out"]).alias("out"),
            (acc["removed"] + hit.cast("int")).alias("removed"),
        )

    def once(acc: Column) -> Column:
        def of(at: Column) -> Column:
            end = at + F.length(keep)
            head, tail = F.substr(acc["out"], F.lit(1), end - 1), F.substr(acc["out"], end)
            rest = F.replace(tail, keep, F.lit(""))
            n = ((F.length(tail) - F.length(rest)) / F.length(keep)).cast("int")
            return F.when(at > 0, F.struct(F.concat(head, rest).alias("out"), (acc["removed"] + n).alias("removed"))).otherwise(acc)

        return let(F.call_function("locate", keep, acc["out"]), of)

    def tidy(acc: Column) -> Column:
        out = acc["out"]
        for pattern, by in (
            (f"(?iU){DANGLING}", ""),
            (r"\(\s*\)", ""),
            (r"[ \t]*\n[ \t]*", " "),
            (r"[ \t]{2,}", " "),
            (r"[ \t]+([.,;:!?])", "$1"),
            (r"(?U)(?<![\s,;:])[\s,;:]+$", ""),
        ):
            out = F.regexp_replace(out, pattern, by)
        return F.struct(strip(out).alias("text"), acc["removed"].alias("removed"))

    unwrapped = F.regexp_replace(text, LINK, "$1 $2")
    others = let(
        unwrapped,
        # Longest first, so that a url that begins another doesn't break it.
        lambda x: F.aggregate(
            F.array_sort(extract_urls(x), lambda a, b: F.length(b) - F.length(a)), zero(x), without
        ),
    )
    return let(let(others, once), tidy)


def audit_numbers(text: Column, context: Column) -> Column:
    """struct<text, actions>: figures that the context doesn't have, verbatim or
    without spaces before units, go; so does a sentence that this leaves mangled."""

    def of(canonical: Column) -> Column:
        def edit(acc: Column, number: Column) -> Column:
            known = F.contains(context, number) | F.contains(canonical, canonical_number(number))
            gone = ~known & F.contains(acc["text"], number)
            return F.struct(
                F.when(gone, strip_number(acc["text"], number)).otherwise(acc["text"]).alias("text"),
                F.when(gone, F.concat(acc["gone"], F.array(number))).otherwise(acc["gone"]).cast(ACTIONS).alias("gone"),
            )

        def sentence(acc: Column, x: Column) -> Column:
            edited = F.aggregate(
                extract_numbers(x), F.struct(x.alias("text"), F.array().cast(ACTIONS).alias("gone")), edit
            )

            def add(e: Column) -> Column:
                dropped = F.transform(e["gone"], lambda n: F.concat(F.lit("dropped_unsupported_number:"), n))
                mangled = (F.size(e["gone"]) > 0) & looks_mangled(e["text"])
                actions = F.concat(
                    acc["actions"], dropped, F.when(mangled, F.array(F.lit("dropped_mangled_sentence"))).otherwise(F.array().cast(ACTIONS))
                )
                kept = strip(e["text"])
                parts = F.when(mangled | (kept == ""), acc["parts"]).otherwise(F.concat(acc["parts"], F.array(kept)))
                return F.struct(parts.cast(ACTIONS).alias("parts"), actions.cast(ACTIONS).alias("actions"))

            return let(edited, add)

        zero = F.struct(F.array().cast(ACTIONS).alias("parts"), F.array().cast(ACTIONS).alias("actions"))
        end = lambda acc: F.struct(F.array_join(acc["parts"], " ").alias("text"), acc["actions"].alias("actions"))
        return F.aggregate(split_sentences(text), zero, sentence, end)

    return let(canonical_number(context), of)


def citation_from(url: Column, chunks: Column) -> Column:
    """Of the best chunk with that url; blank fields if there is none."""
    same = F.filter(chunks, lambda c: normalize_url(c["source_url"]) == normalize_url(url))
    blank = F.struct(url.alias("url"), F.lit("").alias("section"), F.lit("").alias("scheme_name"))
    of = lambda c: F.struct(
        c["source_url"].alias("url"), c["section"].alias("section"), c["scheme_name"].alias("scheme_name")
    )
    return let(same, lambda s: F.when(F.size(s) > 0, of(F.get(s, F.lit(0)))).otherwise(blank))


def when_action(test: Column, action: Callable[[], Column] | str) -> Column:
    value = F.lit(action) if isinstance(action, str) else action()
    return F.when(test, F.array(value)).otherwise(F.array().cast(ACTIONS))


def enforce(answers: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``answers`` (raw, chunks, max_fetched_at) with kind, text, citations,
    last_updated and actions. Each step is a projection; nothing shuffles."""
    keep = [c for c in answers.columns if c not in ("kind", "text", "citations", "last_updated", "actions")]
    budget = s.max_sentences
    rows = answers.withColumn("_open", strip_openers(F.col("raw")))
    rows = rows.withColumn("_urls", F.transform("chunks", lambda c: c["source_url"]))
    rows = rows.withColumn("_allowed", F.transform("_urls", normalize_url))
    rows = rows.withColumn("_marked", resolve_markers(F.col("_open.text"), F.col("_urls")))
    rows = rows.withColumn("_fit", fit_budget(F.col("_marked.text"), budget, F.col("_allowed")))
    rows = rows.withColumn("_found", extract_urls("_fit.text"))
    rows = rows.withColumn("_kept", F.filter("_found", lambda u: F.array_contains("_allowed", normalize_url(u))))
    rows = rows.withColumn("_url", F.get("_kept", F.lit(0)))
    rows = rows.withColumn("_one", F.when(F.col("_url").isNotNull(), keep_one_url(F.col("_fit.text"), F.col("_url"))))
    rows = rows.withColumn("_context", F.array_join(F.transform("chunks", lambda c: c["text"]), "\n"))
    masked = F.replace(F.col("_one.text"), F.col("_url"), F.lit(MASK))
    rows = rows.withColumn("_audit", F.when(F.col("_url").isNotNull(), audit_numbers(masked, F.col("_context"))))
    rows = rows.withColumn("_cited", F.replace(F.col("_audit.text"), F.lit(MASK), F.col("_url")))
    lost = ~F.contains("_cited", F.col("_url"))
    rows = rows.withColumn(
        "_body", F.when(lost, strip(F.concat("_cited", F.lit(" Source: "), "_url"))).otherwise(F.col("_cited"))
    )
    good = (F.col("_open.text") != "") & F.col("_url").isNotNull()
    unverified = F.size("_found") - F.size("_kept")
    text = normalize_ws(F.concat("_body", F.lit(" "), freshness_line(F.col("max_fetched_at"))))
    closed = F.concat(F.lit(NOT_FOUND_TEXT + " "), freshness_line(F.col("max_fetched_at")))
    started = F.col("_open.text") != ""
    number = lambda c: c.cast("string")
    actions = F.concat(
        when_action(F.col("_open.changed"), "stripped_filler"),
        when_action(
            started & (F.size("_marked.markers") > 0),
            lambda: F.concat(F.lit("resolved_chunk_markers:"), F.array_join(F.col("_marked.markers").cast(ACTIONS), ",")),
        ),
        when_action(started & (F.col("_fit.sentences") > budget), f"truncated_to_{budget}_sentences"),
        when_action(started & (unverified > 0), lambda: F.concat(F.lit("dropped_unverified_urls:"), number(unverified))),
        when_action(
            F.coalesce(F.col("_one.removed") > 0, F.lit(False)),
            lambda: F.concat(F.lit("reduced_to_one_citation:"), number(F.col("_one.removed"))),
        ),
        F.coalesce("_audit.actions", F.array().cast(ACTIONS)),
        when_action(F.coalesce(good & lost, F.lit(False)), "restored_citation_after_numeric_audit"),
        when_action(~good, "fail_closed_no_citation"),
    )
    none = F.array().cast(CITATION)
    return rows.select(
        *keep,
        F.when(good, FACTUAL).otherwise(NOT_FOUND).alias("kind"),
        F.when(good, text).otherwise(closed).alias("text"),
        F.when(good, F.array(citation_from(F.col("_url"), F.col("chunks"))).cast(CITATION)).otherwise(none).alias("citations"),
        F.col("max_fetched_at").alias("last_updated"),
        actions.alias("actions"),
    )
