"""Question rules as Column expressions: personal data, advice, performance, in scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewell.functions.text import let, match_spans, str_

ANSWER, REFUSE_PII, REFUSE_ADVICE, REFUSE_PERFORMANCE = "answer", "refuse_pii", "refuse_advice", "refuse_performance"
NOT_IN_SOURCES = "not_in_sources"

# Personal data by kind, in the order in which it is redacted.
PII = (
    ("AADHAAR_MASKED", r"(?iU)\b(?:\d{4}[ \-]?X{4}[ \-]?\d{4}|X{4}[ \-]?X{4}[ \-]?\d{4})\b"),
    ("AADHAAR", r"(?U)(?<![0-9X])\d{4}[ \-]?\d{4}[ \-]?\d{4}(?![0-9])"),
    (
        "ACCOUNT_NUMBER",
        r"(?iU)\b(?:a/c|acc(?:oun)?t|folio)\s*(?:no\.?|number|num)?\s*(?:is|was)?\s*[:#\-]?\s*\d{6,20}\b",
    ),
    ("OTP", r"(?iU)\b(?:otp|one[ \-]?time[ \-]?password)\b\s*(?:is|was|:)?\s*\d{4,8}\b"),
    ("PAN", r"(?U)\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("EMAIL", r"(?iU)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"),
    ("PHONE_INTL", r"(?U)(?<!\d)\+?\d{1,4}[ \-]\d{3,4}[ \-]\d{3,4}(?!\d)"),
    ("PHONE_IN", r"(?U)(?<!\d)(?:\+?91[ \-]?)?[6-9]\d{4}[ \-]?\d{5}(?!\d)"),
)
# Questions that ask for advice; the first that fits names the group.
ADVICE = (
    ("ADVICE_INTENT", r"\bshould\s+i\b"),
    ("ADVICE_INTENT", r"\bshall\s+i\b"),
    ("ADVICE_INTENT", r"\bcan\s+i\s+buy\b"),
    ("ADVICE_INTENT", r"\bwould\s+you\s+(?:buy|recommend|suggest|pick)\b"),
    ("ADVICE_INTENT", r"\bis\s+it\s+(?:a\s+)?good\s+time\b"),
    ("ADVICE_INTENT", r"\bis\s+now\s+a\s+good\s+time\b"),
    ("ADVICE_INTENT", r"\bhow\s+much\s+should\s+i\b"),
    ("ADVICE_INTENT", r"\bshould\s+i\s+(?:allocate|put)\b"),
    ("ADVICE_INTENT", r"\btell\s+me\s+which\b"),
    ("ADVICE_INTENT", r"\bmake\s+me\s+(?:rich|money)\b"),
    ("ADVICE_INTENT", r"\bworth\s+buying\b"),
    ("ADVICE_PREFERENCE", r"\b(?:which|what)\s+is\s+the\s+best\b|\bbest\s+(?:fund|scheme|mutual\s+fund)\b"),
    ("ADVICE_PREFERENCE", r"\brecommend\b"),
    ("ADVICE_PREFERENCE", r"\bsuggest\s+a\b"),
    ("ADVICE_SUITABILITY", r"\bright\s+for\s+me\b"),
    ("ADVICE_SUITABILITY", r"\bsafe\s+for\s+me\b"),
    ("ADVICE_SUITABILITY", r"\bsuitable\s+for\b"),
    ("ADVICE_SUITABILITY", r"\bright\s+for\s+a\s+\d+\s+year[\s-]?old\b"),
)
# Questions that ask for returns to be forecast, compared or ranked.
PERFORMANCE = (
    ("PERF_FORECAST", r"\bhow\s+much\s+will\s+i\s+(?:make|earn|get)\b"),
    ("PERF_FORECAST", r"\bwhat\s+will\s+i\s+(?:get|earn|make)\b"),
    ("PERF_FORECAST", r"\bexpected\s+returns?\b"),
    ("PERF_FORECAST", r"\bprojected\s+returns?\b"),
    ("PERF_FORECAST", r"\bcagr\b"),
    ("PERF_FORECAST", r"\b\d+\s*year\s+returns?\b"),
    ("PERF_FORECAST", r"\bwhat\s+is\s+the\s+(?:\d+\s*year\s+)?returns?\s+of\b"),
    ("PERF_COMPARISON", r"\bcompare\s+the\s+returns?\b"),
    ("PERF_COMPARISON", r"\breturns?\s+(?:of|comparison)\b"),
    (
        "PERF_RANKING",
        r"\bwhich\s+(?:of\s+(?:these|my|the)\s+)?(?:fund|funds|scheme|schemes)\s+(?:performed|performs|has\s+the\s+best)\b",
    ),
    ("PERF_RANKING", r"\b(?:fund|funds|scheme|schemes)\s+(?:that\s+)?performed\s+best\b"),
    ("PERF_RANKING", r"\bbest\s+performing\b"),
    ("PERF_RANKING", r"\bhighest\s+returns?\b"),
    ("PERF_RANKING", r"\bperformance\s+comparison\b"),
)


def redact_pii(s: str | Column) -> Column:
    """Every kind in turn, each on what the ones before left."""
    return reduce(lambda text, p: F.regexp_replace(text, p[1], f"[REDACTED:{p[0]}]"), PII, F.coalesce(str_(s), F.lit("")))


def _redacted(text: Column) -> Column:
    """The same, where the text has what every match has: ``@``, or three digits on end. For
    SQL, which takes no lambdas, there is ``redact_pii``."""
    digits, at = text.rlike(r"(?U)\d{3}"), F.contains(text, F.lit("@"))

    def one(out: Column, p: tuple[str, str]) -> Column:
        kind, pattern = p
        return let(out, lambda x: F.when(at if kind == "EMAIL" else digits, F.regexp_replace(x, pattern, f"[REDACTED:{kind}]")).otherwise(x))

    return F.when(digits | at, reduce(one, PII, text)).otherwise(text)


def first_pii(s: str | Column) -> Column:
    """The first kind that the raw text holds, or null."""
    return first_of(str_(s), PII, "")


def pii_matches(s: str | Column) -> Column:
    """array<struct<kind, value, start, end>> in the order of kinds, on the raw text.
    A match that overlaps one of an earlier kind is left out."""
    text, out = F.coalesce(str_(s), F.lit("")), None
    for kind, pattern in PII:
        spans = F.transform(match_spans(text, pattern), _named(kind))
        out = spans if out is None else let(out, _free(spans))
    return out


def _named(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end"))


def _free(spans: Column):
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    return lambda claimed: F.concat(claimed, F.filter(spans, lambda m: ~F.exists(claimed, lambda c: overlap(m, c))))


def first_of(s: Column, rules: tuple[tuple[str, str], ...], flags: str = "(?iU)") -> Column:
    first, *rest = rules
    out = F.when(s.rlike(flags + first[1]), F.lit(first[0]))
    for name, pattern in rest:
        out = out.when(s.rlike(flags + pattern), F.lit(name))
    return out


def any_of(s: Column, rules: tuple[tuple[str, str], ...], flags: str = "(?iU)") -> Column:
    """Whether one of the rules fits, in one scan; all begin at the edge of a word."""
    return s.rlike(flags + r"\b(?:" + "|".join(p.removeprefix(r"\b") for _, p in rules) + ")")


def classify(query: str | Column) -> Column:
    """struct<action, reason, matched_pattern, confidence, redacted_query>.

    Personal data is looked for in the raw text and comes first; the other rules see
    the redacted text. Expressions don't fail by row; a null that none should give
    counts as personal data.
    """
    raw = F.coalesce(str_(query), F.lit(""))
    none = F.lit(None).cast("string")

    def decision(action: str, reason: str, matched: Column, confidence: float, text: Column) -> Column:
        return F.struct(
            F.lit(action).alias("action"),
            F.lit(reason).alias("reason"),
            matched.alias("matched_pattern"),
            F.lit(confidence).alias("confidence"),
            text.alias("redacted_query"),
        )

    def of(redacted: Column) -> Column:
        # One of the three names is enough to decide, so each is computed once.
        def chosen(m: Column) -> Column:
            return (
                F.when(m["pii"].isNotNull(), decision(REFUSE_PII, "pii_detected", m["pii"], 1.0, redacted))
                .when(m["advice"].isNotNull(), decision(REFUSE_ADVICE, "advice_detected", m["advice"], 0.9, redacted))
                .when(
                    m["performance"].isNotNull(),
                    decision(REFUSE_PERFORMANCE, "performance_detected", m["performance"], 0.9, redacted),
                )
                .otherwise(decision(ANSWER, "in_scope", none, 0.6, redacted))
            )

        def matched(any_: Column) -> Column:
            return F.struct(
                # Redaction changes every text that holds personal data.
                F.when(redacted != raw, first_pii(raw)).alias("pii"),
                F.when(any_, first_of(redacted, ADVICE)).alias("advice"),
                F.when(any_, first_of(redacted, PERFORMANCE)).alias("performance"),
            )

        return let(let(any_of(redacted, ADVICE + PERFORMANCE), matched), chosen)

    blank = ~raw.rlike(r"(?U)\S")
    empty = decision(ANSWER, "empty_query", none, 0.6, raw)
    failed = decision(REFUSE_PII, "classify_error", none, 1.0, F.lit("[REDACTED]"))
    return F.when(blank, empty).otherwise(F.coalesce(let(let(raw, _redacted), of), failed))
