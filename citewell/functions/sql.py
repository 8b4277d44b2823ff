"""The text functions and rules as SQL functions of a session.

``register`` declares each as a SQL expression, which is inlined where it is called:
nothing runs in Python. Functions that are folds over arrays have no SQL text and are
left to the DataFrame side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from citewell.functions import guard, text

#: Name, parameters with their types, and the expression over columns of these names.
FUNCTIONS: tuple[tuple[str, tuple[tuple[str, str], ...], Callable[..., Column]], ...] = (
    ("normalize_ws", (("s", "STRING"),), text.normalize_ws),
    ("canonical_number", (("s", "STRING"),), text.canonical_number),
    ("estimate_tokens", (("s", "STRING"),), text.count_tokens),
    ("exceeds_limit", (("s", "STRING"),), text.exceeds_limit),
    ("context_header", (("name", "STRING"), ("category", "STRING"), ("plan", "STRING"), ("section", "STRING")), text.context_header),
    ("body_budget", (("header", "STRING"),), text.body_budget),
    ("strip_context_header", (("s", "STRING"),), text.strip_context_header),
    ("is_bare_label", (("line", "STRING"),), text.is_bare_label),
    ("is_value_only", (("line", "STRING"),), text.is_value_only),
    ("amount", (("s", "STRING"),), text.amount),
    ("amounts_match", (("a", "DOUBLE"), ("b", "DOUBLE")), text.amounts_match),
    ("freshness_line", (("fetched_at", "STRING"),), text.freshness_line),
    ("without_freshness", (("s", "STRING"),), text.without_freshness),
    ("looks_mangled", (("s", "STRING"),), text.looks_mangled),
    ("redact_pii", (("s", "STRING"),), guard.redact_pii),
    ("first_pii", (("s", "STRING"),), guard.first_pii),
)


def _sql(spark: SparkSession, parameters: tuple[tuple[str, str], ...], build: Callable[..., Column]) -> str:
    none = spark.createDataFrame([], ", ".join(f"{name} {kind}" for name, kind in parameters))
    plan = none.select(build(*(F.col(name) for name, _ in parameters)).alias("v"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Declare all of ``FUNCTIONS`` as temporary functions; their names."""
    for name, parameters, build in FUNCTIONS:
        declared = ", ".join(f"{p} {kind}" for p, kind in parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURN {_sql(spark, parameters, build)}")
    return [name for name, _, _ in FUNCTIONS]
