"""Feature assembly and standard scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class ScalerModel:
    """Per-column mean and population sd fitted on the training rows."""
    means: dict[str, float]
    sds: dict[str, float]

    def scaled(self, col: str) -> Column:
        sd = self.sds[col]
        divisor = sd if sd not in (0.0, None) else 1.0
        return (F.col(col) - F.lit(self.means[col])) / F.lit(divisor)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Replace (or, with ``suffix``, add) the scaled columns."""
        cols = {f"{c}{suffix}": self.scaled(c) for c in self.means}
        return df.withColumns(cols)


def standard_scale_fit(train: DataFrame, cols: Sequence[str]) -> ScalerModel:
    """One aggregate pass: mean and *population* sd per column (sd 0 -> divide by 1)."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    row = train.agg(*aggs).first()
    return ScalerModel({c: row[f"m{i}"] for i, c in enumerate(cols)},
                       {c: row[f"s{i}"] for i, c in enumerate(cols)})


def array_to_columns(df: DataFrame, array_col: str, size: int, prefix: str = "f") -> tuple[DataFrame, list[str]]:
    """Explode a fixed-size numeric array into ``size`` double columns."""
    names = [f"{prefix}{i}" for i in range(size)]
    return df.select("*", *[F.col(array_col)[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)
