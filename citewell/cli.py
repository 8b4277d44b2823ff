"""``python -m citewell.cli answer --store S --manifest M --aliases A [--query Q ...]``"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from citewell.config import settings
from citewell.operators.chunking import chunk_documents, chunk_report, violations
from citewell.operators.durable import durable
from citewell.operators.enforce import ERROR
from citewell.operators.store import Store
from citewell.plans.answer import answer
from citewell.plans.ingest import build, cached_and_missing, documents_of, report
from citewell.sources import tables
from citewell.sources.http import fetch_into


def session() -> SparkSession:
    return SparkSession.builder.appName("citewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    """1 if a source failed.

    Documents are kept in a store of versions, where the next run finds those it need not
    fetch; the file of JSON lines is written from it. Pages that came before a run stopped
    are kept beside it."""
    s = settings(spark)
    manifest = tables.read_sources(spark, a.manifest)
    cache = Store(spark, f"{a.documents}-cache")
    cached = cache.read()
    cached = tables.load_documents(spark, a.documents) if cached is None else cached
    hits, missing = cached_and_missing(manifest, cached if not a.force else cached.limit(0))
    raw = f"{a.documents}-raw" + (f"-{uuid.uuid4().hex}" if a.force else "")
    pages = fetch_into(missing, raw, s)
    docs, failed = documents_of(pages, manifest, s)
    failed = durable(failed, "failed")
    cache.write(hits.unionByName(docs), force=True)
    docs = cache.read()
    tables.write_json(docs, a.documents, ("scheme_id",))
    tables.write_json(report(docs, failed, pages), f"{a.documents}-report")
    build(docs, Store(spark, a.store), s)
    return int(not failed.isEmpty())


def chunk(spark: SparkSession, a: argparse.Namespace) -> int:
    """1 if a chunk breaks a rule."""
    chunks = chunk_documents(tables.load_documents(spark, a.documents), settings(spark)).persist()
    tables.write_json(chunks, a.out, ("scheme_id", "chunk_index"))
    chunk_report(chunks).orderBy("scheme_id").show(1000, False)
    found = violations(chunks).persist()
    found.show(1000, False)
    return int(not found.isEmpty())


def ask(spark: SparkSession, a: argparse.Namespace) -> int:
    """1 if an answer is an error."""
    lines = a.query or [x for line in sys.stdin if (x := line.strip())]
    stop = next((k for k, x in enumerate(lines) if x.lower() in tables.EXIT_WORDS and not a.query), len(lines))
    rows = spark.createDataFrame(list(enumerate(lines[:stop])), "query_id bigint, query string")
    corpus = Store(spark, a.store).read()
    if corpus is None:
        print("the corpus has not been built", file=sys.stderr)
        return 1
    manifest, aliases = tables.source_index(spark, a.manifest), tables.read_aliases(spark, a.aliases)
    answers = answer(rows, corpus, manifest, aliases, settings(spark)).persist()
    line = tables.answer_payload() if a.json else tables.print_record(F.col("query_id") + 1)
    for r in answers.select("query_id", line.alias("line")).orderBy("query_id").toLocalIterator():
        print(r.line)
    return int(not answers.where(F.col("kind") == ERROR).isEmpty())


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="citewell")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run, wanted in (
        ("ingest", ingest, ("manifest", "documents", "store")),
        ("chunk", chunk, ("documents", "out")),
        ("answer", ask, ("store", "manifest", "aliases")),
    ):
        p = commands.add_parser(name)
        for w in wanted:
            p.add_argument(f"--{w}", required=True)
        p.set_defaults(run=run)
        if name == "ingest":
            p.add_argument("--force", action="store_true")
        if name == "answer":
            p.add_argument("--query", action="append")
            p.add_argument("--json", action="store_true")
    a = parser.parse_args(args)
    return a.run(session(), a)


if __name__ == "__main__":
    sys.exit(main())
