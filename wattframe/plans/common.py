"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named double columns so engine-specific summation order does
    not change the compared value (the DuckDB oracle rounds the same way)."""
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])
