"""Vector arithmetic on array columns."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero or the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), norm(a)))


def parsed(text: Column) -> Column:
    """A list literal as doubles; null if it is none."""
    return F.from_json(text, "array<double>")


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A stand-in embedder: signed counts of a text's words and letter pairs by hash, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            t = (t or "").lower()
            grams = t.split() + [t[i : i + 2] for i in range(len(t) - 1)]
            h = np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in grams], np.int64)
            return np.bincount(h % size, 1.0 - 2 * (h >> 31), minlength=size)

        return texts.map(one)

    return embed(text)
