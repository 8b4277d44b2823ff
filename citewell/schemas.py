"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), False) for n in names]


SOURCE = T.StructType(_strings("scheme_id", "scheme_name", "category", "plan", "url"))
SECTION = T.StructType(
    [
        T.StructField("section_title", T.StringType()),
        T.StructField("heading_level", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("is_table", T.BooleanType()),
        T.StructField("order", T.IntegerType()),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "scheme_id", "scheme_name", "category", "plan", "source_url", "fetched_at", "content_sha256", "extraction_mode",
        )
    ]
    + [T.StructField("sections", T.ArrayType(SECTION))]
)
CHUNK = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("chunk_id", "scheme_id", "scheme_name", "category", "plan", "section", "source_url", "fetched_at")
    ]
    + [
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("is_table", T.BooleanType()),
        T.StructField("content_sha256", T.StringType()),
        T.StructField("embed_text", T.StringType()),
        T.StructField("display_text", T.StringType()),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("scheme_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)
TURN = T.StructType(
    [
        T.StructField("redacted_query", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("generation_mode", T.StringType()),
        T.StructField("citation_urls", T.ArrayType(T.StringType())),
    ]
)
