"""Text encoders: a hashing one that needs no model, and a slot for others.

An encoder is any function from a list of texts to a matrix of unit rows. It is
loaded once in each Python worker and fed Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell import ship
from citewell.config import Settings
from citewell.functions.text import content_tokens

#: Makes an encoder; called in the worker, so it may load a model there.
Loader = Callable[[], Callable[[list[str]], np.ndarray]]
BATCH = 32


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def dense(hashes: Iterator, dimensions: int) -> np.ndarray:
    """Signed counts of hashed tokens, as unit rows; no token gives zeros."""
    sizes = np.array([0 if own is None else len(own) for own in hashes], dtype=np.int64)
    flat = [np.asarray(own, dtype=np.int64) for own in hashes if own is not None]
    h = np.concatenate([*flat, np.zeros(0, dtype=np.int64)]).view(np.uint64)
    place = np.repeat(np.arange(len(sizes)), sizes) * dimensions + (h % np.uint64(dimensions)).astype(np.int64)
    out = np.bincount(place, np.where(h >> np.uint64(63), -1.0, 1.0), len(sizes) * dimensions).reshape(-1, dimensions)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


def hashing(text: str | Column, dimensions: int = Settings.dimensions) -> Column:
    """Tokens are found and hashed in the JVM; only hashes go to Python."""

    ship()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(dense(batch, dimensions)))

    return vectors(hashed(content_tokens(text)))


def with_model(text: str | Column, load: Loader, dimensions: int, double: bool = False) -> Column:
    """Unit rows in single precision, or with ``double`` as the model gives them."""
    ship()
    kind = np.float64 if double else np.float32

    @F.pandas_udf(T.ArrayType(T.DoubleType() if double else T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = [np.asarray(encode(texts[k : k + BATCH]), dtype=kind) for k in range(0, len(texts), BATCH)]
            found = np.concatenate(parts) if parts else np.zeros((0, dimensions), dtype=kind)
            if found.shape != (len(texts), dimensions):
                raise ValueError(f"the encoder gave {found.shape}, not {(len(texts), dimensions)}")
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            yield pd.Series(list(found / np.where(norm == 0, 1, norm)))

    return vectors(F.col(text) if isinstance(text, str) else text)


def encode(
    rows: DataFrame, text: str, out: str = "embedding", load: Loader | None = None, dimensions: int = Settings.dimensions, double: bool = False
) -> DataFrame:
    """``rows`` with a unit vector of ``text``; ``double`` is for a given model."""
    vector = hashing(text, dimensions) if load is None else with_model(text, load, dimensions, double)
    return rows.withColumn(out, vector)


def dot(a: Column, b: Column) -> Column:
    """In double precision, in the JVM."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )
