"""Least squares by tall-skinny QR.

Each partition reduces its rows to the R factor of a QR decomposition, batch by batch;
R factors are then merged in a tree of ``FANOUT`` at a time. What moves is one d x d
triangle per partition, and the condition of the design is not squared as it is in a
Gram matrix. Coefficients come from the triangle and are refined once against the rows
(corrected semi-normal equations, a second pass with d sums).

The rank is that of the triangle with columns of length 1, counted with a tolerance
that is a parameter. A design without full rank gives the coefficients of least norm
(in scaled columns) and says so in ``rank``; ``strict`` makes it an error. Rows with a
missing value are left out; a table without rows is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.session import ensure_checkpoint_dir

FANOUT = 16
BATCH_VALUES = 1 << 21


@dataclass
class LeastSquares:
    beta: np.ndarray
    rank: int
    n_rows: int
    residual: float  # sum of squares

    @property
    def full_rank(self) -> bool:
        return self.rank == len(self.beta)


def triangle(parts: Sequence[np.ndarray]) -> np.ndarray:
    """R of the rows of all parts."""
    return np.linalg.qr(np.vstack(parts), mode="r")


def r_factor(df: DataFrame, columns: Sequence[str], fanout: int = FANOUT) -> tuple[np.ndarray, int]:
    """R factor of the columns (as doubles) and the number of rows without a missing value."""
    m = len(columns)
    ensure_checkpoint_dir(df.sparkSession)

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(m)])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n, step = None, 0, max(1, BATCH_VALUES // m)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                x = rows_of(batch.slice(a, step))
                n += len(x)
                r = triangle([x] if r is None else [r, x])
        if r is not None:
            yield row(TaskContext.get().partitionId(), n, r)

    def row(part: int, n: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))],
                                          names=["part", "n", "r"])

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")  # the same order whatever the shuffle
        r = triangle([np.array(x).reshape(-1, m) for x in rows["r"].to_pylist()])
        return pa.Table.from_batches([row(rows["up"][0].as_py(), sum(rows["n"].to_pylist()), r)])

    schema = "part long, n long, r array<double>"
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    level = values.mapInArrow(local, schema).checkpoint(eager=True)
    while level.count() > fanout:
        level = level.withColumn("up", F.expr(f"part div {fanout}")).groupBy("up").applyInArrow(merge, schema).checkpoint(eager=True)
    last = sorted(level.collect(), key=lambda x: x["part"])
    if not last:
        raise ValueError("no rows without a missing value")
    return triangle([np.array(x["r"]).reshape(-1, m) for x in last]), sum(x["n"] for x in last)


def least_squares(df: DataFrame, columns: Sequence[str], target: str, tolerance: float | None = None, strict: bool = False) -> LeastSquares:
    """``target`` on ``columns`` (give a column of ones for an intercept). A column counts
    as dependent if its singular value is below ``tolerance`` times the largest (by
    default the rounding of a sum over the rows, d * 2^-52 * 8)."""
    d = len(columns)
    r, n = r_factor(df, [*columns, target])
    square = np.zeros((d + 1, d + 1))
    square[: len(r)] = r
    x, y = square[:d, :d], square[:d, d]
    length = np.linalg.norm(x, axis=0)
    length[length == 0] = 1.0
    u, s, vt = np.linalg.svd(x / length)
    tolerance = d * 2.0**-52 * 8 if tolerance is None else tolerance
    rank = int((s > tolerance * s[0]).sum()) if s.size and s[0] > 0 else 0
    if strict and rank < d:
        raise ValueError(f"the design has rank {rank} of {d}")
    inverse = np.where(np.arange(d) < rank, 1.0 / np.where(s > 0, s, 1.0), 0.0)

    def solve(rhs: np.ndarray) -> np.ndarray:
        return vt.T @ (inverse * (u.T @ rhs)) / length

    beta = solve(y)
    # once more against the rows: d sums of column times residual
    residual = F.col(target).cast("double")
    for c, b in zip(columns, beta):
        residual = residual - F.lit(float(b)) * F.col(c).cast("double")
    rows = df.select(*columns, target).dropna().withColumn("_residual", residual)
    sums = rows.agg(*[F.sum(F.col(c).cast("double") / F.lit(float(w)) * F.col("_residual")).alias(f"s{i}") for i, (c, w) in enumerate(zip(columns, length))],
                    F.sum(F.col("_residual") ** 2).alias("ss")).first()
    g = np.array([sums[f"s{i}"] for i in range(d)])
    beta = beta + vt.T @ (inverse**2 * (vt @ g)) / length
    return LeastSquares(beta, rank, n, float(sums["ss"]))
