"""Helpers shared by the training-data operators.

Words are runs of characters other than space and U+0009..U+000D. On UTF-8
bytes that is exactly what ``bytes.split()`` cuts at, and ``bytes.lower()``
lower-cases A-Z only, so the Python operators work on bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.session import ensure_checkpoint_dir

SPACE = r"[ \t-\r]+"
BROADCAST_ROWS = 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def frozen(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder: later jobs read the same rows
    in the same partitions, also after executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def join_table(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left",
               broadcast_rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Join rows with a frozen table of one row per key.

    The table is counted: up to ``broadcast_rows`` rows it is broadcast. Beyond
    that the rows are salted and the table repeated once per salt, so that one
    hot key does not meet in one task. ``df`` must not have a column ``_salt``."""
    if table.count() <= broadcast_rows:
        return df.join(F.broadcast(table), on=list(keys), how=how)
    spread = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, on=[*keys, "_salt"], how=how).drop("_salt")
