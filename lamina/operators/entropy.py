"""Which contents are worth compressing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 3.92  # bits of a nibble; data at or above it in every sample is left as it is


def _bits(content: bytes) -> float:
    counts = np.bincount(np.frombuffer(content, np.uint8) >> 4, minlength=16)
    p = counts[counts > 0] / max(1, len(content))
    return float(-(p * np.log2(p)).sum()) if len(content) else 0.0


def nibble_entropy(content: Column) -> Column:
    """Shannon entropy in bits of the high nibbles of the bytes; 0 for no bytes. One count over the bytes of an Arrow batch."""

    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else _bits(c) for c in rows], dtype="float64")

    return F.when(content.isNotNull(), run(content))


def compressible(content: Column, least: int = 131072, window: int = 1024, samples: int = 8, limit: float = LIMIT) -> Column:
    """True below `least` bytes, or if any of the samples spread over the content has an entropy under the limit."""

    @F.pandas_udf("boolean")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else sampled_compressible(c, least, window, samples, limit) for c in rows], dtype=object)

    return run(content)


def sampled_compressible(content: bytes, least: int = 131072, window: int = 1024, samples: int = 8, limit: float = LIMIT) -> bool:
    if len(content) < least:
        return True
    step = (len(content) - 2 * window) // samples
    return any(_bits(content[step * i + window : step * i + 2 * window]) < limit for i in range(samples))
