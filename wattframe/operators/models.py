"""Model fitting and scoring.

Linear least squares needs only the Gram matrix (X'X, X'y, y'y, n), which is
one distributed aggregate with d(d+3)/2 sums (partial aggregation per
partition); the d x d solve happens on the driver, as MLlib's normal solver
does.  Gradient descent on the squared loss is a linear recurrence in the
weights, so its T steps are also computed from the Gram matrix (by repeated
squaring) without touching the rows again.  Logistic and network models use
MLlib, whose optimisers aggregate gradients with ``treeAggregate``.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import scalars as S
from wattframe.operators.features import assemble
from wattframe.operators.tsqr import least_squares

INTERCEPT = "1"


# --- Gram matrix ----------------------------------------------------------------

def _terms(features: Sequence[str], target: str | None, intercept: bool) -> list[str]:
    return ([INTERCEPT] if intercept else []) + list(features) + ([target] if target else [])


def _term_col(t: str) -> Column:
    return F.lit(1.0) if t == INTERCEPT else F.col(t).cast("double")


def gram_matrix(df: DataFrame, features: Sequence[str], target: str | None = None,
                intercept: bool = True) -> DataFrame:
    """Upper triangle of [1, x..., y]'[1, x..., y] in long form (term_i, term_j, value).

    One aggregate; the (1, 1) entry is n, the (1, x) entries are column sums."""
    terms = _terms(features, target, intercept)
    pairs = [(a, b) for i, a in enumerate(terms) for b in terms[i:]]
    agg = df.agg(*[F.sum(_term_col(a) * _term_col(b)).alias(f"g{k}") for k, (a, b) in enumerate(pairs)])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("term_i"), F.lit(b).alias("term_j"), F.col(f"g{k}").alias("value"))
        for k, (a, b) in enumerate(pairs)])))


def gram_arrays(df: DataFrame, features: Sequence[str], target: str,
                intercept: bool = True) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(A = X'X, b = X'y, y'y, n) as numpy arrays, X with a leading 1 column."""
    terms = _terms(features, target, intercept)
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    row = df.agg(*[F.sum(_term_col(terms[i]) * _term_col(terms[j])).alias(f"g{k}")
                   for k, (i, j) in enumerate(pairs)],
                 F.count(F.lit(1)).alias("n")).first()
    m = len(terms)
    full = np.zeros((m, m))
    for k, (i, j) in enumerate(pairs):
        v = row[f"g{k}"] or 0.0
        full[i, j] = full[j, i] = v
    d = m - 1
    return full[:d, :d], full[:d, d], full[d, d], float(row["n"])


# --- linear models --------------------------------------------------------------

@dataclass
class LinearModel:
    intercept: float
    coefficients: dict[str, float] = field(default_factory=dict)
    rank: int | None = None  # of the design with its intercept, where the fit finds it

    def predict_expr(self) -> Column:
        expr = F.lit(float(self.intercept))
        for c, w in self.coefficients.items():
            expr = expr + F.lit(float(w)) * F.col(c)
        return expr

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.predict_expr())

    def as_dataframe(self, spark) -> DataFrame:
        rows = [(INTERCEPT, float(self.intercept))] + [(k, float(v)) for k, v in self.coefficients.items()]
        return spark.createDataFrame(rows, "term string, coefficient double")


def linreg_ols(df: DataFrame, features: Sequence[str], target: str, method: str = "normal") -> LinearModel:
    """Least squares with intercept.  ``normal``: one pass for means and deviations,
    one for the Gram matrix of the standardised columns, a d x d solve, and the scaling
    undone, so columns of very different size keep their digits; ``qr``: tall-skinny QR,
    for designs whose condition a Gram matrix would square, with the rank in the model;
    ``mllib``: ``LinearRegression(solver='normal', regParam=0)``."""
    features = list(features)
    if method == "qr":
        one = df.select(F.lit(1.0).alias("_one"), *features, target)
        fit = least_squares(one, ["_one", *features], target)
        return LinearModel(float(fit.beta[0]), dict(zip(features, map(float, fit.beta[1:]))), fit.rank)
    if method == "mllib":
        lr = LinearRegression(featuresCol="_f", labelCol=target, solver="normal", regParam=0.0,
                              standardization=False, fitIntercept=True)
        m = lr.fit(assemble(df.select(*features, target), features, "_f"))
        return LinearModel(float(m.intercept), dict(zip(features, map(float, m.coefficients.toArray()))))
    columns = [*features, target]
    moments = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
                     *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    mean = [moments[f"m{i}"] or 0.0 for i in range(len(columns))]
    scale = [moments[f"s{i}"] or 1.0 for i in range(len(columns))]
    z = df.select(*[((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(f"z{i}")
                    for i, (c, m, s) in enumerate(zip(columns, mean, scale))])
    a, b, _, _ = gram_arrays(z, [f"z{i}" for i in range(len(features))], f"z{len(features)}")
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    slopes = [float(w) * scale[-1] / s for w, s in zip(beta[1:], scale)]
    intercept = mean[-1] + float(beta[0]) * scale[-1] - sum(w * m for w, m in zip(slopes, mean))
    return LinearModel(intercept, dict(zip(features, slopes)))


def linreg_gd(df: DataFrame, features: Sequence[str], target: str, lr: float = 0.001, epochs: int = 100,
              batch_size: int = 32) -> LinearModel:
    """Gradient descent on the mean squared error with the step count of the
    mini-batch run (epochs x ceil(n / batch)), starting from zero weights.

    Each step is beta <- (I - cA) beta + c b with c = 2 lr / n, so T steps are
    the T-th power of a (d+1)x(d+1) matrix - computed by repeated squaring."""
    a, b, _, n = gram_arrays(df, features, target)
    steps = int(epochs * math.ceil(n / batch_size))
    d = len(b)
    c = 2.0 * lr / n
    aug = np.eye(d + 1)
    aug[:d, :d] -= c * a
    aug[:d, d] = c * b
    beta = np.linalg.matrix_power(aug, steps)[:d, d]
    return LinearModel(float(beta[0]), dict(zip(features, map(float, beta[1:]))))


# --- classifiers (MLlib) ----------------------------------------------------------

PARTITION_BYTES = 64 << 20
LEAST_BYTES = 4 << 20  # a core's partition is not made smaller than this


def _fit(estimator, train: DataFrame, features: Sequence[str], label: str, partition_bytes: int = PARTITION_BYTES):
    """Fit an iterative MLlib estimator on assembled features.

    Each optimiser iteration is one Spark job over the training set, so the set is
    cached for the fit, in one partition for each core (fewer where they would hold less
    than ``LEAST_BYTES``), or in more where a partition would pass ``partition_bytes``.
    Returns (model, n_rows)."""
    data = assemble(train.select(*features, label), features, "_f").select("_f", label)
    n = data.count()
    row_bytes = 8 * (len(features) + 1) + 64
    cores = train.sparkSession.sparkContext.defaultParallelism
    size = n * row_bytes
    parts = max(min(cores, -(-size // LEAST_BYTES)), -(-size // partition_bytes), 1)
    data = data.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator(n).fit(data), n
    finally:
        data.unpersist()


def logreg_l2(train: DataFrame, features: Sequence[str], label: str, C: float = 1.0,
              max_iter: int = 10000):
    """L2 logistic regression with the C-parametrisation: regParam = 1 / (C n),
    no standardisation, intercept not penalised."""
    return _fit(lambda n: LogisticRegression(featuresCol="_f", labelCol=label, regParam=1.0 / (C * n),
                                             elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                                             fitIntercept=True, tol=1e-6),
                train, features, label)[0]


def logreg_plain(train: DataFrame, features: Sequence[str], label: str, max_iter: int = 100):
    """Unpenalised logistic regression (the optimum the SGD/Adam runs approach)."""
    return _fit(lambda n: LogisticRegression(featuresCol="_f", labelCol=label, regParam=0.0, maxIter=max_iter,
                                             fitIntercept=True),
                train, features, label)[0]


def mlp_classify(train: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int] = (32, 16),
                 max_iter: int = 100, seed: int = 42, block_size: int = 128):
    """Feed-forward network d -> 32 -> 16 -> 2 (MLlib: sigmoid hidden units,
    softmax output, L-BFGS)."""
    layers = [len(features), *hidden, 2]
    return _fit(lambda n: MultilayerPerceptronClassifier(featuresCol="_f", labelCol=label, layers=layers,
                                                         maxIter=max_iter, seed=seed, blockSize=block_size),
                train, features, label)[0]


def batch_score(model, df: DataFrame, features: Sequence[str], cut: float = 0.5, inclusive: bool = False,
                out: str = "prediction") -> DataFrame:
    """Apply a fitted model.  Linear models become a column expression;
    classifiers give ``probability`` (class 1) and a thresholded class."""
    if isinstance(model, LinearModel):
        return model.transform(df, out)
    scored = model.transform(assemble(df, features, "_f"))
    p = vector_to_array("probability")[1]
    return (scored.withColumn("probability_1", p)
            .withColumn(out, S.threshold("probability_1", cut, inclusive))
            .drop("_f", "rawPrediction", "probability"))


def fit_time(fn, *args, **kwargs):
    """(result, seconds) for a fit or an action."""
    t0 = time.perf_counter()
    res = fn(*args, **kwargs)
    return res, time.perf_counter() - t0
