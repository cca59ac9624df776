"""Vectors as bytes, and which of them take part."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """A pandas column of equally long arrays as float64."""
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products, summed from the first component to the last: the same in any batch."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
