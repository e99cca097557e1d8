"""Scalar tests and classification of cell values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Most breaks compared one by one in generated code.
TREE_BREAKS = 16


def is_data(z: Column | str) -> Column:
    """True where the cell holds a value; NULL and NaN both count as NoData."""
    z = F.col(z) if isinstance(z, str) else z
    return z.isNotNull() & ~F.isnan(z)


def is_positive(z: Column | str) -> Column:
    """True where the whole-number part of a valid cell exceeds zero."""
    z = F.col(z) if isinstance(z, str) else z
    return is_data(z) & (F.floor(z) > 0)


def or_default(value: Column | str, default) -> Column:
    """An optional request parameter with its default."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value, F.lit(default))


def class_index(z: Column | str, breaks: Sequence[float]) -> Column:
    """Index of the first break not below ``z``; values above all breaks fall in the last class.

    A few breaks become a comparison tree in generated code. The JVM does not compile a tree over
    many of them, so those are searched in Arrow batches.
    """
    z = F.col(z) if isinstance(z, str) else z
    ordered = [float(b) for b in breaks]
    if not ordered or ordered != sorted(ordered):
        raise ValueError("breaks must be a non-empty ascending sequence")
    if len(ordered) > TREE_BREAKS:
        limits = np.array(ordered[:-1])

        @F.pandas_udf("int")
        def search(values: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(limits, values.to_numpy(dtype=np.float64)).astype(np.int32))

        return F.when(is_data(z), search(z))

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(z <= F.lit(ordered[middle]), pick(low, middle)).otherwise(pick(middle + 1, high))

    return F.when(is_data(z), pick(0, len(ordered) - 1))
