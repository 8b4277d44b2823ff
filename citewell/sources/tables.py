"""Manifests, documents, chunks, aliases, questions and answers on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell.errors import ConfigError
from citewell.functions.text import strip
from citewell.operators.ordinals import by_file
from citewell.schemas import CHUNK, DOCUMENT, SOURCE

COLUMNS = tuple(SOURCE.fieldNames())
#: Words that end a session of questions.
EXIT_WORDS = ("exit", "quit", ":q", "bye")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', multiLine=True)


def _numbered(rows: DataFrame) -> DataFrame:
    """With the file of each row, its line there (the header is line 1) and its place among
    all rows. A quoted field may hold line feeds, so a file is one split; a folder's
    files are read side by side, each with its own header."""
    rows = by_file(rows.withColumn("_file", F.col("_metadata.file_path")), "_at")
    # One row a file.
    first = rows.groupBy(F.col("_file").alias("_of")).agg(F.min("_at").alias("_first"))
    joined = rows.join(F.broadcast(first), F.col("_file") == F.col("_of"))
    return joined.withColumn("_line", F.col("_at") - F.col("_first") + 2).drop("_of", "_first")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, stripped, without blank rows. A missing column or an empty
    required field raises with its line (the header is line 1)."""
    rows = _csv(spark, path)
    missing = [c for c in COLUMNS if c not in rows.columns]
    if missing:
        raise ConfigError(f"{path} lacks column(s): {', '.join(missing)}")
    value = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    rows = _numbered(rows)
    blank = F.forall(F.array(*(value(c) for c in rows.columns if c not in ("_file", "_at", "_line"))), lambda v: v == "")
    empty = F.filter(F.array(*(F.when(value(c) == "", F.lit(c)) for c in COLUMNS)), lambda c: c.isNotNull())
    rows = rows.where(~blank)
    bad = rows.where(F.size(empty) > 0).select("_file", "_line", "_at", empty.alias("empty")).orderBy("_at").first()
    if bad:
        raise ConfigError(f"{bad['_file']} line {bad['_line']}: empty field(s): {', '.join(bad['empty'])}")
    return rows.select(*(value(c).alias(c) for c in COLUMNS))


def source_index(spark: SparkSession, path: str) -> DataFrame:
    """scheme_id, scheme_name, url; never raises: what can't be read is empty, rows
    without id or url go, the last row of an id wins."""
    schema = "scheme_id string, scheme_name string, url string"
    try:
        rows = _numbered(_csv(spark, path))
        value = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
        rows = rows.select("_at", *(value(c).alias(c) for c in ("scheme_id", "scheme_name", "url")))
    except Exception:  # noqa: BLE001  any trouble with the file
        return spark.createDataFrame([], schema)
    last = F.row_number().over(W.partitionBy("scheme_id").orderBy(F.col("_at").desc()))
    rows = rows.where("scheme_id <> '' AND url <> ''").withColumn("_nth", last).where("_nth = 1")
    return rows.select("scheme_id", "scheme_name", "url")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """scheme_id, alias (in lower case) from a JSON object of lists."""
    kind = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("scheme_id", "a"))
    return rows.select("scheme_id", F.explode("a").alias("alias")).select("scheme_id", F.lower("alias").alias("alias"))


def archive_pages(pages: DataFrame, path: str) -> None:
    """Raw HTML by scheme, replaced as a whole."""
    pages.select("scheme_id", "html").write.mode("overwrite").parquet(path)


def write_json(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """Lines of JSON in UTF-8; in one order if one is given, so that equal rows make
    equal bytes."""
    rows = rows.orderBy(*order) if order else rows
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Declared columns; no file is no documents, and blank lines are no rows."""
    return _read_json(spark, path, DOCUMENT)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, CHUNK)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query: lines that aren't blank, up to one that ends the session. The
    file, or the files of a folder in order, are one session, numbered by line."""
    rows = by_file(spark.read.text(path), "query_id").select("query_id", strip(F.col("value")).alias("query"))
    ended = rows.where(F.lower("query").isin(*EXIT_WORDS)).agg(F.min("query_id")).first()[0]
    return rows.where("query <> ''" if ended is None else f"query <> '' AND query_id < {ended}")


def answer_payload() -> Column:
    """One answer as JSON. The question is not in it."""
    fields = (
        "kind", "generation_mode", F.round("max_similarity", 4).alias("top_similarity"), "text", "citations", "last_updated",
        F.col("guard.action").alias("guard_action"), F.col("guard.reason").alias("guard_reason"),
        F.col("actions").alias("postprocess_actions"), "llm_latency_ms", "corpus_fingerprint",
    )
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def print_record(index: Column) -> Column:
    """One answer for people."""
    lines = (
        F.concat(F.lit("── ["), index.cast("string"), F.lit("] ─────────────────────────────")),
        F.concat(F.lit("kind: "), "kind"),
        F.concat(F.lit("mode: "), "generation_mode"),
        F.concat(F.lit("top_sim: "), F.coalesce(F.format_string("%.2f", "max_similarity"), F.lit("n/a"))),
        F.concat(F.lit("answer: "), "text"),
        F.concat(F.lit("citation: "), F.coalesce(F.get("citations", F.lit(0))["url"], F.lit("-"))),
        F.concat(F.lit("last_updated: "), F.coalesce("last_updated", F.lit("n/a"))),
    )
    return F.concat_ws("\n", *lines)
