"""Evaluation in one aggregate pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """n, MSE, RMSE, MAE and R^2 = 1 - SSE / SST (SST about the evaluated rows' mean)."""
    err = F.col(label) - F.col(prediction)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("_sse"), F.avg(F.abs(err)).alias("MAE"),
                 F.var_pop(label).alias("_vp"))
    mse = F.col("_sse") / F.col("n")
    return agg.select("n", mse.alias("MSE"), F.sqrt(mse).alias("RMSE"), "MAE",
                      (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_vp") * F.col("n"))).alias("r2_score"))


def _safe(num, den):
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Accuracy and precision / recall / F1 of class 1; 0 when a denominator is 0."""
    y, p = F.col(label), F.col(prediction)
    agg = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision = _safe(tp, tp + fp)
    recall = _safe(tp, tp + fn)
    return agg.select("tp", "fp", "fn", "tn",
                      _safe(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                      precision.alias("precision"), recall.alias("recall"),
                      _safe(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"))


def accuracy_only(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def preview_predictions(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` predictions by key (a top-k: TakeOrderedAndProject)."""
    return df.orderBy(key).limit(n)
