"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a dimension or lookup table. No hint: Spark compares measured bytes with
    ``spark.sql.autoBroadcastJoinThreshold`` and broadcasts only what is below it."""
    return big.join(small, on=on, how=how)


def unmatched_keys(left: DataFrame, lookup: DataFrame, left_key: str, lookup_key: str) -> DataFrame:
    """Distinct keys of ``left`` with no entry in ``lookup`` (left anti join)."""
    return (left.select(F.col(left_key).alias("_k")).distinct()
            .join(lookup.select(F.col(lookup_key).alias("_k")), on="_k", how="left_anti")
            .withColumnRenamed("_k", left_key))
