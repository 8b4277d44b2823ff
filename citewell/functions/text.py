"""Text functions as Column expressions: they run inside the JVM, next to the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citewell import ship


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def str_(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<value, start, end>> of a pattern's matches, in characters from 0."""

    def of(both: Column) -> Column:
        total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda acc, x: acc + F.length(x))

        def one(m: Column, i: Column) -> Column:
            start = total(both["pieces"], i + 1) + total(both["found"], i)
            return F.struct(m.alias("value"), start.alias("start"), (start + F.length(m)).alias("end"))

        return F.transform(both["found"], one)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("pieces")), of)


# Characters folded to ASCII, and characters deleted.
FOLD_FROM = "\u2018\u2019\u201b\u201c\u201d\u201e\u2032\u2033\u2013\u2014\u2212\xa0"
FOLD_TO = "'''\"\"\"'\"--- "
DELETED = "\u200c\u200d\ufeff"
#: White space as text processing sees it, beyond Java's Unicode class.
BLANK = r"[\s\x1c-\x1f\x85]"
#: Line ends.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, rf"(?U){BLANK}+", " "))


def normalize_ws(s: str | Column) -> Column:
    """Fold typographic characters, delete zero-width ones, collapse white space."""
    folded = F.translate(F.coalesce(str_(s), F.lit("")), FOLD_FROM + DELETED, FOLD_TO)
    return collapse(folded)


def split_lines(s: str | Column) -> Column:
    return F.split(F.coalesce(str_(s), F.lit("")), LINE_END, -1)


def normalize_lines(s: str | Column) -> Column:
    """Each line normalised, blank ones dropped."""
    return F.array_join(F.filter(F.transform(split_lines(s), normalize_ws), lambda x: x != ""), "\n")


# Tokens that end in a dot without ending a sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "rs", "no", "e.g", "i.e", "vs", "cf", "approx", "fy")
_END = "[.!?…]"
#: A mark set behind what ends no sentence though it looks so. A text's own mark is followed
#: by another; both are noncharacters.
_HELD, _OWN = "\ufdd0", "\ufdd1"
_ABBR = "|".join(sorted((a.replace(".", r"\.") for a in ABBREVIATIONS), key=len, reverse=True))
#: An abbreviation with its dots, and end marks between digits.
_KEPT = rf"(?<![A-Za-z.])\.*+(?i:{_ABBR})\.++(?=[ \t\n])|(?<=\p{{Nd}}){_END}++(?=[ \t]++\p{{Nd}})"
#: A boundary is blanks after an end mark, or line feeds; none before a lower-case letter.
SENTENCE_END = rf"(?=[ \t])(?<={_END})[ \t]++(?!\p{{Ll}})|(?=\n)(?<![\n{_HELD}])\n++"


def _held(text: Column) -> Column:
    """The text with marks behind abbreviations and between digits, so that no blank or
    line feed there follows an end mark."""
    own = F.when(F.contains(text, F.lit(_HELD)), F.replace(text, F.lit(_HELD), F.lit(_HELD + _OWN))).otherwise(text)
    marked = F.regexp_replace(own, _KEPT, f"$0{_HELD}")
    # Line feeds behind an abbreviation and blanks are held as well; those behind digits are not.
    return F.regexp_replace(marked, rf"(?<=\.){_HELD}([ \t]++)(?=\n)", f"{_HELD}$1{_HELD}")


def _freed(piece: Column) -> Column:
    bare = F.replace(F.regexp_replace(piece, f"{_HELD}(?!{_OWN})", ""), F.lit(_HELD + _OWN), F.lit(_HELD))
    return F.when(F.contains(piece, F.lit(_HELD)), bare).otherwise(piece)


def strip(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(s, rf"(?U)^{BLANK}+|(?<!{BLANK}){BLANK}+$", "")


def split_sentences(s: str | Column) -> Column:
    pieces = F.split(_held(F.coalesce(str_(s), F.lit(""))), SENTENCE_END, -1)
    return F.filter(F.transform(pieces, lambda x: strip(_freed(x))), lambda x: x != "")


def truncate_sentences(s: str | Column, n: int) -> Column:
    """struct<text, sentences>: at most ``n`` sentences, and how many there were."""
    text = F.coalesce(str_(s), F.lit(""))
    cut = lambda a: F.struct(
        F.when(F.lit(n) < 1, F.lit(""))
        .when(F.size(a) <= n, text)
        .otherwise(F.array_join(F.slice(a, 1, max(n, 1)), " "))
        .alias("text"),
        F.size(a).alias("sentences"),
    )
    return let(split_sentences(text), cut)


# Query keys that track, and closing marks cut from the ends of urls.
TRACKING = ("ref", "referrer", "source", "fbclid", "gclid", "gbraid", "wbraid", "msclkid", "igshid", "mc_cid", "mc_eid")
CLOSERS = "】］〉》」』〕"
URL_TAIL = ".,;:!?)" + CLOSERS
URL_EDGE = ".,;:!?)]}'\"" + CLOSERS
URL = rf"https?://[^\s)\]}}\"'<>`{CLOSERS}]+"
MARKDOWN_LINK = r"\[([^\]]*)\]\((https?://[^)]+)\)"


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in r"\]^-[" else c for c in chars) + "]"


def rstrip(s: Column, chars: str) -> Column:
    return F.rtrim(s, F.lit(chars))


def normalize_url(u: str | Column) -> Column:
    """Canonical form: no scheme, ``www.``, fragment, trailing slash or tracking
    parameters; host in lower case; the other parameters sorted."""
    text = rstrip(strip(F.coalesce(str_(u), F.lit(""))), URL_TAIL)
    bare = F.regexp_replace(text, "^(?i:https?)://", "")

    def whole(url: Column) -> Column:
        head = F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
        has_query = F.contains(url, F.lit("?"))
        query = F.when(has_query, F.substr(url, F.locate("?", url) + 1)).otherwise("")
        host = F.regexp_replace(F.lower(F.split_part(head, F.lit("/"), F.lit(1))), r"^www\.", "")
        path = F.when(F.contains(head, F.lit("/")), rstrip(F.substr(head, F.locate("/", head) + 1), "/")).otherwise("")
        key = lambda p: F.lower(strip(F.split_part(p, F.lit("="), F.lit(1))))
        kept = F.filter(
            F.split(query, "&", -1), lambda p: (p != "") & ~F.startswith(key(p), F.lit("utm_")) & ~key(p).isin(*TRACKING)
        )
        tail = let(F.sort_array(kept), lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(""))
        return let(
            F.struct(host.alias("host"), F.concat(path, tail).alias("path")),
            lambda p: F.when(p["path"] != "", F.concat(p["host"], F.lit("/"), p["path"])).otherwise(p["host"]),
        )

    return let(bare, whole)


def unwrap_links(s: Column) -> Column:
    return F.regexp_replace(s, MARKDOWN_LINK, "$1 $2")


def extract_urls(s: str | Column) -> Column:
    """Distinct urls in order of first appearance."""
    found = F.regexp_extract_all(unwrap_links(F.coalesce(str_(s), F.lit(""))), F.lit("(?U)" + URL), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda x: rstrip(x, URL_EDGE)), lambda x: x != ""))


# The surface forms of figures, tried in this order.
NUMBER = "|".join(
    (
        r"(?:₹|Rs\.?|INR)\s*\d[\d,]*(?:\.\d+)?(?:[% ]*%)?",
        r"\d[\d,]*\.\d+\s*%",
        r"\d[\d,]*%",
        r"\d{1,3}(?:,\d{2,3})+(?:\.\d+)?(?:\s*%)?",
        r"\d+\.\d+",
        r"\d+(?:\s*(?:years?|yrs?|months?|days?))?",
    )
)


def extract_numbers(s: str | Column) -> Column:
    """Figures as written, distinct, in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(str_(s), F.lit("")), F.lit("(?U)" + NUMBER), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))


def canonical_number(s: str | Column) -> Column:
    """Without white space before a unit suffix."""
    return F.regexp_replace(F.coalesce(str_(s), F.lit("")), rf"(?U){BLANK}+(?=[%)\]])", "")


def remove_first(s: Column, part: Column) -> Column:
    at = F.call_function("locate", part, s)
    cut = F.concat(F.substr(s, F.lit(1), at - 1), F.substr(s, at + F.length(part)))
    return F.when((part != "") & (at > 0), cut).otherwise(s)


def strip_number(s: str | Column, number: Column) -> Column:
    """Without the first occurrence of a figure; empty if no letter or digit stays."""
    text = F.coalesce(str_(s), F.lit(""))
    out = F.regexp_replace(remove_first(text, number), r"[ \t]+([.,;:!?])", "$1")
    out = strip(F.regexp_replace(out, r"[ \t]{2,}", " "))
    out = F.regexp_replace(out, rf"(?U)^[\s,;:]+|(?<![\s,;:])[\s,;:]+$", "")
    edited = let(out, lambda x: F.when(x.rlike(r"(?U)\d") | x.rlike("[A-Za-z]"), x).otherwise(""))
    return F.when(F.coalesce(number, F.lit("")) == "", text).otherwise(edited)


def count_tokens(s: str | Column, chars: int = 4) -> Column:
    """Estimated tokens: one for every started group of ``chars`` characters."""
    return F.ceil(F.length(F.coalesce(str_(s), F.lit(""))) / F.lit(chars)).cast("int")


def count_tokens_with(s: str | Column, load: Callable[[], Callable[[list[str]], list[int]]]) -> Column:
    """Tokens as a tokenizer counts them; ``load`` makes it once in each worker."""
    ship()

    @F.pandas_udf("int")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for batch in batches:
            yield pd.Series(count(batch.fillna("").tolist()), dtype="int32")

    return counts(str_(s))


def exceeds_limit(s: str | Column, limit: int = 256) -> Column:
    return count_tokens(s) > limit


def context_header(name: Column, category: Column, plan: Column, section: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit("[Scheme: "), text(name), F.lit(" | Category: "), text(category), F.lit(" | Plan: "), text(plan),
        F.lit(" | Section: "), text(section), F.lit("]"),
    )


def body_budget(header: Column, most: int = 240) -> Column:
    return F.greatest(F.lit(1), F.lit(most) - count_tokens(header) - 1)


def strip_context_header(s: str | Column) -> Column:
    text = str_(s)
    cut = F.when(F.contains(text, F.lit("\n")), F.substr(text, F.locate("\n", text) + 1)).otherwise(text)
    return F.when(F.startswith(text, F.lit("[Scheme:")), cut).otherwise(text)


# Words that say nothing about a question's subject.
STOPWORDS = tuple(
    """
    a an the of for in on to and or is are was were be been being am
    what which who whom whose when where why how much many any all some
    do does did done can could should would will shall may might must
    i me my we our you your it its this that these those there here
    tell please give get need want know about with from as by at
    if so but not no nor too very just also then there s t
    fund funds mutual hdfc scheme schemes
    """.split()
)


def content_tokens(s: str | Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case runs of letters and digits, without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(str_(s), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, dict.fromkeys(stopwords)))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


# Decimal digits, with the blocks that a JVM of Unicode 13 (Java 17) has no entries for.
DIGIT = r"[\p{Nd}\x{11f50}-\x{11f59}\x{16ac0}-\x{16ac9}\x{1e4f0}-\x{1e4f9}]"


def is_bare_label(line: Column) -> Column:
    return ~line.rlike(DIGIT)


# How a line of a table looks.
VALUE_ONLY = rf"(?iU)^(?:[+-]|₹|rs\.?)?{BLANK}*[{DIGIT},]+(?:\.{DIGIT}+)?{BLANK}*%?$"


def is_value_only(line: Column) -> Column:
    """A figure alone, with at most a sign or currency before and a percent sign after."""
    bare = F.regexp_replace(strip(line), r"₹|Rs\.|rs\.", "")
    return (strip(line) != "") & ~F.contains(bare, F.lit(" ")) & strip(line).rlike(VALUE_ONLY)


def amount(s: Column) -> Column:
    """The number in a figure, null if there is none."""
    return F.regexp_replace(s, r"[^\d.]", "").try_cast("double")


def amounts_match(left: Column, right: Column) -> Column:
    return F.abs(left - right) <= F.greatest(F.lit(1.0), F.abs(right) * 0.001)


FRESHNESS = "Last updated from sources:"


def freshness_line(fetched_at: Column) -> Column:
    return F.concat(F.lit(f"{FRESHNESS} "), F.coalesce(fetched_at, F.lit("unknown")))


def without_freshness(s: Column) -> Column:
    return F.trim(F.substring_index(s, FRESHNESS, 1))


# Words that cannot end a sentence, and pairs that show a hole.
TAIL_WORDS = (
    "is are was were be of at to about around approximately roughly nearly for and or as by with from in on than "
    "equals stands set the a an its their this that these those up"
).split()
COPULAS = "is are was were".split()
CONNECTIVES = (
    "if when at on in of for from with by to since unless after before about around approximately roughly nearly"
).split()


def looks_mangled(s: Column) -> Column:
    """What taking out a figure leaves when the figure held the sentence together."""
    tail, copula, connective = ("|".join(w) for w in (TAIL_WORDS, COPULAS, CONNECTIVES))
    return (
        ~s.rlike("[A-Za-z]{2,}")
        | s.rlike(rf"(?i)(?<![A-Za-z])(?:{tail})[^A-Za-z]*$")
        | s.rlike(rf"(?iU)\b(?:{copula})\s+(?:{connective})\b")
        | s.rlike(rf"(?iU)\b(?:{tail})\s*[.,;:]")
    )
