"""citewell: a Spark-native engine for grounded retrieval and corpus preparation."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark import SparkContext


def ship() -> None:
    """Let this session's Python workers import the package from where the driver did.

    On a cluster whose machines don't share that folder, install the package there or
    pass it with ``--py-files``.
    """
    sc, root = SparkContext._active_spark_context, str(Path(__file__).resolve().parent.parent)
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
