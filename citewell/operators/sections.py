"""Documents from sections: table blocks, figure repair, renumbering, hashing.

Sections stay an array inside their document, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.functions.text import (
    BLANK,
    DIGIT,
    amount,
    amounts_match,
    is_value_only,
    let,
    normalize_lines,
    normalize_ws,
    split_lines,
    strip,
)

# Lines that hold a label and its value, and how many make a table.
LABEL_COLON_VALUE = rf"(?U)^{BLANK}*[\p{{L}}\p{{N}}_ ()%/-]{{2,40}}{BLANK}*[:\-]{BLANK}*\S+"
LABEL_TRAILING_NUMBER = rf"(?iU)^.{{2,60}}?{BLANK}+(?:₹|rs\.?{BLANK}*)?[{DIGIT},]+(?:\.{DIGIT}+)?{BLANK}*%?$"
TABLE_PAIRS = 3

# A scheme's figure, its house's figure, and prose that states one.
MONEY = r"[₹]?\s*[\d,]+(?:\.\d+)?\s*Cr"
SCHEME_FIGURE = rf"(?iU)Fund\s+size\s*\(\s*AUM\s*\)\s*({MONEY})"
HOUSE_FIGURE = rf"(?iU)Total\s+AUM\s*({MONEY})"
PROSE_FIGURE = rf"(?iU)(Asset\s+Under\s+Management\s*\(?\s*AUM\s*\)?\s*(?:is|of)\s*)({MONEY})"


def count_pairs(lines: Column) -> Column:
    """Label and value pairs, on one line or on two that follow each other."""
    zero = F.struct(F.lit(0).alias("pairs"), F.lit(False).alias("pending"))
    state = lambda pairs, pending: F.struct(pairs.cast("int").alias("pairs"), pending.alias("pending"))

    def step(acc: Column, raw: Column) -> Column:
        def of(line: Column) -> Column:
            both = line.rlike(LABEL_COLON_VALUE) | line.rlike(LABEL_TRAILING_NUMBER)
            return (
                F.when(line == "", state(acc["pairs"], F.lit(False)))
                .when(both, state(acc["pairs"] + 1, F.lit(False)))
                .when(is_value_only(line), state(acc["pairs"] + acc["pending"].cast("int"), F.lit(False)))
                .otherwise(state(acc["pairs"], F.lit(True)))
            )

        return let(strip(raw), of)

    return F.aggregate(lines, zero, step, lambda acc: acc["pairs"])


def is_table_block(text: Column, in_table: Column | None = None, pairs: int = TABLE_PAIRS) -> Column:
    counted = count_pairs(split_lines(text)) >= pairs
    return counted if in_table is None else F.coalesce(in_table, F.lit(False)) | counted


def document_hash(sections: Column) -> Column:
    return F.sha2(normalize_ws(F.array_join(F.transform(sections, lambda s: s["text"]), " ")), 256)


def _with_text(s: Column, text: Column) -> Column:
    return F.struct(
        s["section_title"].alias("section_title"),
        s["heading_level"].alias("heading_level"),
        text.alias("text"),
        s["is_table"].alias("is_table"),
        s["order"].alias("order"),
    )


def repair_figures(docs: DataFrame) -> DataFrame:
    """Prose that gives the house's figure for the scheme's gets the scheme's first
    figure; the document's hash follows. Running it again changes nothing."""
    all_of = lambda pattern: F.flatten(
        F.transform("sections", lambda s: F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(1)))
    )
    rows = docs.withColumn("_scheme", all_of(SCHEME_FIGURE)).withColumn("_house", all_of(HOUSE_FIGURE))

    def rewritten(text: Column) -> Column:
        """Matches are replaced one after another; pieces between them stay."""
        pieces = F.split(text, PROSE_FIGURE, -1)
        heads = F.regexp_extract_all(text, F.lit(PROSE_FIGURE), F.lit(1))
        money = F.regexp_extract_all(text, F.lit(PROSE_FIGURE), F.lit(2))

        def one(m: Column) -> Column:
            near = lambda figures: F.exists(figures, lambda f: amounts_match(amount(m), amount(f)))
            return F.when(~near("_scheme") & near("_house"), F.get(F.col("_scheme"), F.lit(0))).otherwise(m)

        tails = F.transform(F.arrays_zip(heads.alias("h"), money.alias("m")), lambda x: F.concat(x["h"], one(x["m"])))
        joined = let(
            pieces,
            lambda p: F.array_join(
                F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.get(tails, i), F.lit("")))), ""
            ),
        )
        return F.when(text.rlike(PROSE_FIGURE), joined).otherwise(text)

    repairable = (F.size("_scheme") > 0) & (F.size("_house") > 0)
    fixed = F.transform("sections", lambda s: _with_text(s, rewritten(s["text"])))
    rows = rows.withColumn("_fixed", F.when(repairable, fixed).otherwise(F.col("sections")))
    changed = F.exists(F.arrays_zip("sections", "_fixed"), lambda x: x["sections"]["text"] != x["_fixed"]["text"])
    rows = rows.withColumn("content_sha256", F.when(changed, document_hash(F.col("_fixed"))).otherwise(F.col("content_sha256")))
    return rows.withColumn("sections", F.col("_fixed")).drop("_scheme", "_house", "_fixed")


def build_documents(pages: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """From manifest columns, final_url, extraction_mode and raw sections: bodies
    normalised, empty ones dropped, the rest numbered, hashed and repaired."""
    day = F.date_format(F.current_date(), "yyyy-MM-dd") if fetched_at is None else fetched_at
    title = lambda s: let(normalize_ws(s["section_title"]), lambda t: F.when(t == "", "Untitled").otherwise(t))
    clean = F.filter(
        F.transform("sections", lambda s: _with_text(s, normalize_lines(s["text"]))), lambda s: s["text"] != ""
    )
    numbered = lambda a: F.transform(
        a,
        lambda s, i: F.struct(
            title(s).alias("section_title"),
            s["heading_level"].alias("heading_level"),
            s["text"].alias("text"),
            s["is_table"].alias("is_table"),
            i.alias("order"),
        ),
    )
    docs = pages.withColumn("sections", clean).withColumn("sections", numbered(F.col("sections")))
    docs = docs.select(
        "scheme_id", "scheme_name", "category", "plan",
        F.col("final_url").alias("source_url"),
        day.alias("fetched_at"),
        document_hash(F.col("sections")).alias("content_sha256"),
        "extraction_mode", "sections",
    )
    return repair_figures(docs)


def document_stats(docs: DataFrame) -> DataFrame:
    """Sections, table sections and characters of each document."""
    return docs.select(
        "scheme_id",
        F.size("sections").alias("n_sections"),
        F.size(F.filter("sections", lambda s: s["is_table"])).alias("n_tables"),
        F.aggregate("sections", F.lit(0), lambda n, s: n + F.length(s["text"])).alias("n_chars"),
    )
