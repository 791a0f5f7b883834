"""Table preparation: drops, label handling, dummies, sentinels, derived metrics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.functions import scalars as S


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def drop_columns(df: DataFrame, cols: Sequence[str], strict: bool = True) -> DataFrame:
    """Remove columns; ``strict`` raises on an unknown name (pandas default),
    otherwise unknown names are ignored (``errors='ignore'``)."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column (the rule on entry)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(S.nan_to_null(f.name).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop a row if any (or any listed) column is NULL or NaN (``dropna()``)."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def split_features_target(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    """Target first as ``label``, every other column kept as a feature."""
    feats = [c for c in df.columns if c != target]
    return df.select(F.col(target).alias(label), *feats)


def select_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Keep numeric columns only (``select_dtypes(include='number')``) minus ``exclude``."""
    return df.select(*numeric_columns(df, exclude))


def detect_label_column(df: DataFrame, labels: Sequence[str] = ("m", "b")) -> DataFrame:
    """One-row DataFrame naming the first column (in order) where any value, as
    lower-case text, is in ``labels``.  One aggregate pass over all columns.
    ``label_column`` is NULL when there is none."""
    lab = [x.lower() for x in labels]
    hits = [F.coalesce(F.bool_or(F.lower(F.col(c).cast("string")).isin(lab)), F.lit(False)).alias(f"h{i}")
            for i, c in enumerate(df.columns)]
    agg = df.agg(*hits)
    cand = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("label_column"),
                              F.col(f"h{i}").alias("hit"))
                     for i, c in enumerate(df.columns)])
    first = F.get(F.filter(cand, lambda s: s["hit"]), 0)
    return agg.select(first["label_column"].alias("label_column"), first["position"].alias("position"))


def detect_label_column_name(df: DataFrame, labels: Sequence[str] = ("m", "b")) -> str:
    row = detect_label_column(df, labels).first()
    if row is None or row["label_column"] is None:
        raise ValueError("No column with labels %s found" % (list(labels),))
    return row["label_column"]


MAX_LEVELS = 10_000


def category_levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list[str]:
    """Sorted distinct categories (small fitted state, like an encoder's vocabulary).
    At most ``max_levels`` are fetched; more is an error, not a silent cut."""
    rows = (df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect())
    if len(rows) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} categories; one-hot columns are not sensible")
    return sorted(r[0] for r in rows)


def one_hot_drop_first(df: DataFrame, col: str, levels: Sequence[str] | None = None,
                       prefix: str | None = None) -> DataFrame:
    """Dummy columns for every sorted category but the first; the source column
    is replaced.  Nothing happens when ``col`` is absent (as in the scripts)."""
    if col not in df.columns:
        return df
    levels = sorted(levels) if levels is not None else category_levels(df, col)
    pre = prefix if prefix is not None else col
    dummies = [F.coalesce((F.col(col) == lv).cast("int"), F.lit(0)).alias(f"{pre}_{lv}") for lv in levels[1:]]
    return df.select(*[c for c in df.columns if c != col], *dummies)


def sentinel_to_null(df: DataFrame, sentinel: float = S.SENTINEL) -> DataFrame:
    """Sentinel -> NULL in every numeric column."""
    num = set(numeric_columns(df))
    return df.select(*[S.null_if_sentinel(c, sentinel).alias(c) if c in num else F.col(c) for c in df.columns])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def tag_platform(df: DataFrame, value: str, name: str = "Platform") -> DataFrame:
    return df.withColumn(name, F.lit(value))


def derive_laptop_metrics(df: DataFrame, energy: str = "Total_Energy_J", time: str = "Time_Taken_s",
                          accuracy: str = "Accuracy_Pct") -> DataFrame:
    """M2 energy, M3 time, M4 accuracy, M5 accuracy per joule (unguarded ratio)."""
    return df.withColumns({
        "M2_Total_Energy_J": F.col(energy),
        "M3_Execution_Time_s": F.col(time),
        "M4_Model_Accuracy": F.col(accuracy),
        "M5_Energy_Efficiency": S.plain_ratio(accuracy, energy),
    })


def derive_board_metrics(df: DataFrame, energy: str = "CPU_Energy_J", duration_ns: str = "Duration_ns",
                         accuracy: str = "Accuracy_Pct") -> DataFrame:
    """Duration in s, M1 average power, M2 energy, M3 time, M5 efficiency (guarded)."""
    df = df.withColumn("Duration_s", S.ns_to_s(duration_ns))
    cols = {
        "M1_Avg_Power_W": S.guarded_ratio(energy, "Duration_s"),
        "M2_Total_Energy_J": F.col(energy),
        "M3_Exec_Time_s": F.col("Duration_s"),
    }
    if accuracy in df.columns:
        cols["M5_Energy_Efficiency"] = S.guarded_ratio(accuracy, energy)
    return df.withColumns(cols)
