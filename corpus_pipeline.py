"""The corpus pipeline: documents in, training pieces out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; between stages the rows are a written table. All but the last return the
columns of the input, whatever further columns there are and however they are named.

Defined results, for every stage: a null text counts as an empty one (and stays null);
texts of any length are read whole; repeated rows each have their own result, but for
near_duplicates, where they are copies of one another; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citewell.llm import mixing, neardup, pieces, quality, secrets
from citewell.llm.common import clean, documents, durable, made


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go, those without a text among them.
    The rows that stay are as they were."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: the row of its smallest
    doc_id (null only if all are null), of rows that share it the one with the smallest
    hash of its text. Rows with equal or null ids and different texts are told apart.
    Links are those of the operator's query: three-word shingles, at most two bits."""
    return neardup.keep_representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are redacted; widely copied examples and clean texts stay as they are.
    No row goes. Where a text changes, n_chars follows; a null source is one owner."""
    return secrets.redact_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and cut so that each source gives its target of words. A null
    source is one more source, after all others; where the cut falls among rows equal in
    doc_id and text, they go in the order of their other columns."""
    return mixing.mix_documents(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of every row's pieces: doc_id, n_tokens and hashes."""
    return pieces.digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("piece_encoding", piece_encoding),
]

#: SQL has no SimHash components and no piece encoding; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. When one has been written, the tables of those
    before it go; the last written one stays, since the result reads it."""
    docs, before = documents(spark, sf_dir), made()
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clean(spark, since=before, keep=f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
