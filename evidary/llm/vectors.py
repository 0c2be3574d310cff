"""Which vectors take part in comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column, rows: int) -> np.ndarray:
    """The rows of a pandas column of arrays of one length as a float64 matrix."""
    return np.stack(column.to_numpy()).astype(np.float64) if rows else np.zeros((0, 0))
