"""Vector functions as column expressions, and feature hashing in batches. Sums are taken in double precision."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    length = F.array_repeat(norm(v), F.size(v))  # once a row: inside the lambda it would be computed for each element
    return F.zip_with(v, length, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN if either vector is zero, which sorts last."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, 1 - dot(a, b) / lengths).otherwise(F.lit(float("nan")))


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def token_bucket(token: str, dimensions: int) -> int:
    """From the first 32 bits of MD5, so that other engines can repeat it."""
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dimensions


class Buckets(dict):
    """token -> bucket, remembered by a worker up to a bound."""

    KEPT = 500_000

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        bucket = token_bucket(token, self.dimensions)
        if len(self) < self.KEPT:
            self[token] = bucket
        return bucket


@lru_cache(maxsize=4)
def worker_buckets(dimensions: int) -> Buckets:
    return Buckets(dimensions)


#: Characters whose words a worker holds at a time (a longer text is cut by itself).
HELD = 1_000_000


def hashed_counts(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """(texts, dimensions): how many tokens of each cleaned text fall in each bucket, counted over pieces of the batch."""
    bucket = worker_buckets(dimensions).__getitem__
    piece = np.cumsum([len(text) if text else 0 for text in texts]) // HELD
    edges = [0, *(np.nonzero(np.diff(piece))[0] + 1).tolist(), len(texts)] if texts else [0]
    out = np.zeros((len(texts), dimensions))
    for start, end in pairwise(edges):
        cut = [text.split() if text else [] for text in texts[start:end]]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        own = np.fromiter(map(bucket, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        cell = np.repeat(np.arange(len(cut)) * dimensions, sizes) + own
        out[start:end] = np.bincount(cell, minlength=len(cut) * dimensions).reshape(len(cut), dimensions)
    return out


def hashing_counts(dimensions: int = DIMENSIONS):
    """Vectorised function: how many tokens of a cleaned text fall in each bucket, as array<double>.

    Called non-deterministic, so that no filter on its result is pushed below it, which would repeat it.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def count(cleaned: pd.Series) -> pd.Series:
        return pd.Series(list(hashed_counts(cleaned.tolist(), dimensions)))

    return count.asNondeterministic()
