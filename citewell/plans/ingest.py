"""Building the corpus: manifest to pages, documents, chunks, vectors, store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.config import Settings
from citewell.operators.chunking import chunk_documents
from citewell.operators.encode import Loader, encode
from citewell.operators.sections import build_documents, repair_figures
from citewell.operators.store import Store
from citewell.sources.html import extract_pages


def cached_and_missing(manifest: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents at hand, with the manifest's names and repaired; and the rows of the
    manifest that have to be fetched."""
    names = manifest.select("scheme_id", *(F.col(c).alias(f"_{c}") for c in ("scheme_name", "category", "plan")))
    hits = cached.join(names, "scheme_id")
    for c in ("scheme_name", "category", "plan"):
        hits = hits.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    missing = manifest.join(cached.select("scheme_id"), "scheme_id", "left_anti")
    return repair_figures(hits.select(*cached.columns)), missing


def documents_of(pages: DataFrame, manifest: DataFrame, s: Settings = Settings(), fetched_at=None) -> tuple[DataFrame, DataFrame]:
    """Documents, and the pages that failed (scheme_id, error): each fails alone."""
    rows = pages.withColumnRenamed("error", "fetch_error")
    found = extract_pages(rows, "html", s).join(manifest.drop("url"), "scheme_id")
    found = found.withColumn("error", F.coalesce("fetch_error", "error"))
    good = build_documents(found.where("error IS NULL"), fetched_at)
    return good, found.where("error IS NOT NULL").select("scheme_id", "error")


def report(docs: DataFrame, failed: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row: sources_ok, sources_failed, documents, max_fetched_at, warnings."""
    each = F.struct("scheme_id", F.size("sections").alias("sections"), F.substring("content_sha256", 1, 12).alias("hash"))
    ok = docs.agg(
        F.count(F.lit(1)).alias("sources_ok"),
        F.array_sort(F.collect_list(each)).alias("documents"),
        F.max("fetched_at").alias("max_fetched_at"),
    )
    bad = failed.agg(
        F.array_sort(F.collect_list("scheme_id")).alias("sources_failed"),
        F.array_sort(F.collect_list(F.concat("scheme_id", F.lit(": "), "error"))).alias("errors"),
    )
    rows = ok.join(bad)
    moved = F.array().cast("array<string>")
    if pages is not None:
        text = F.concat("scheme_id", F.lit(": redirected "), "url", F.lit(" -> "), "final_url")
        rows = rows.join(pages.where("final_url <> url").agg(F.array_sort(F.collect_list(text)).alias("moved")))
        moved = F.col("moved")
    return rows.select(
        "sources_ok", "sources_failed", "documents", "max_fetched_at", F.concat("errors", moved).alias("warnings")
    )


def embedded(chunks: DataFrame, load: Loader | None = None, s: Settings = Settings()) -> DataFrame:
    """Chunks with the vector of header and body, which finds them, and of the body
    alone, which tells them apart."""
    rows = encode(chunks, "embed_text", "embedding", load, s.dimensions)
    return encode(rows, "display_text", "body_embedding", load, s.dimensions)


def build(docs: DataFrame, store: Store, s: Settings = Settings(), load: Loader | None = None) -> bool:
    """Chunk, encode and store; False if there was nothing to store."""
    chunks = chunk_documents(docs, s)
    return store.write(embedded(chunks, load, s), position="chunk_index")
