"""Positions of all matches of a pattern, with DataFrame functions alone.

``split`` and ``regexp_extract_all`` walk the same matches, so the pieces between
matches give every match its place in code points. Patterns given here begin where
a run of their characters begins and repeat possessively: each text is scanned
once, whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,value:string,left:array<string>,right:array<string>>>"


def found(text: Column, pattern: str) -> Column:
    """The matched strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def nearest_words(piece: Column, n: int) -> Column:
    """The first ``n`` words of a piece, fewer where it has fewer. Runs are taken
    possessively from the start, so that only these words are read."""
    lead = r"^[\x20\x09-\x0D]*+"
    more = "".join(r"(?:[\x20\x09-\x0D]++([^\x20\x09-\x0D]++))?+" for _ in range(n - 1))
    pattern = f"{lead}([^\\x20\\x09-\\x0D]++)?+{more}"
    return F.filter(F.array(*(F.regexp_extract(piece, pattern, k + 1) for k in range(n))), lambda w: w != "")


def placed(text: Column, matches: Column, pattern: str, near: int = 0) -> Column:
    """``matches`` with their places, and the ``near`` nearest words on either side, up
    to the next match.

    ``matches`` must be a column of its own (not an expression), so that texts
    without a match are not scanned again.
    """
    pieces = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"), F.lit("").alias("piece"))
    none = F.array().cast("array<string>")
    left = lambda p: F.transform(nearest_words(F.reverse(p), near), lambda w: F.reverse(w)) if near else none
    right = lambda p: nearest_words(p, near) if near else none

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(
            start.cast("bigint").alias("start"),
            end.cast("bigint").alias("end"),
            x["m"].alias("value"),
            left(x["p"]).alias("left"),
            right(x["q"]).alias("right"),
        )
        return F.struct(
            end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(span)).cast(SPAN).alias("out"), F.lit("").alias("piece")
        )

    def all_of(p: Column) -> Column:
        zipped = F.transform(
            matches, lambda m, i: F.struct(m.alias("m"), F.get(p, i).alias("p"), F.get(p, i + 1).alias("q"))
        )
        return F.aggregate(zipped, zero, step, lambda acc: acc["out"])

    # A one-element array binds the pieces to a name, so that the text is split once.
    bound = F.flatten(F.transform(F.array(pieces), all_of))
    return F.when(F.size(matches) > 0, bound).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in the array's order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ","
    )


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
