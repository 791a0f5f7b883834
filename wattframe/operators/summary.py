"""Grouped summaries and the data behind the study's charts.

Every function returns a DataFrame; charts themselves are not drawn.  All
aggregates are partial (map-side) aggregates; exact quantiles are selected between
bounds of a sketch (``selection``), so no group is ever held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions import scalars as S
from wattframe.operators.selection import MOST_GROUPS, frozen_small, quantiles, renamed_keys, same_group


def summary_two_keys(df: DataFrame, keys: Sequence[str], metrics: dict[str, str],
                     accuracy: str | None = "Accuracy_Pct") -> DataFrame:
    """Per key combination: N, mean and sample sd of each metric, mean accuracy.

    ``metrics`` maps short name (``M2``) -> column; output ``Mean_M2``, ``SD_M2``.
    """
    aggs = [F.count(F.lit(1)).alias("N")]
    for short, col in metrics.items():
        aggs += [F.avg(col).alias(f"Mean_{short}"), F.stddev_samp(col).alias(f"SD_{short}")]
    if accuracy:
        aggs.append(F.avg(accuracy).alias("Mean_Accuracy"))
    return df.groupBy(*keys).agg(*aggs)


def summary_one_key(df: DataFrame, key: str, metrics: dict[str, str]) -> DataFrame:
    """Per group: N and the mean of each metric ignoring NULLs (``mean(na.rm=TRUE)``)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("N"),
                               *[F.avg(col).alias(f"Mean_{short}") for short, col in metrics.items()])


def group_mean(df: DataFrame, keys: Sequence[str], metric: str, label: str = "fixed2") -> DataFrame:
    """Bar data: mean of ``metric`` per group with its text label.

    ``label``: ``fixed2`` (%.2f), ``fixed3`` (%.3f), ``pct2`` (%.2f%%) or
    ``sci_or_fixed`` (%.2e above 1000, else %.2f)."""
    out = df.groupBy(*keys).agg(F.avg(metric).alias("Mean"))
    fmt = {
        "fixed2": S.format_fixed("Mean", 2),
        "fixed3": S.format_fixed("Mean", 3),
        "pct2": S.format_fixed("Mean", 2, "%%"),
        "sci_or_fixed": S.format_sci_or_fixed("Mean"),
    }[label]
    return out.withColumn("label", fmt)


def axis_headroom(means: DataFrame, col: str = "Mean", factor: float = 1.1) -> DataFrame:
    """Upper axis limit: ``factor`` x the largest group mean (one row)."""
    return means.agg((F.max(col) * F.lit(factor)).alias("y_limit"))


def non_null_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: number of present values and whether there is any (chart gate)."""
    agg = df.agg(*[F.count(c).alias(f"n_{c}") for c in cols])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"n_{c}").alias("n_present"),
                 (F.col(f"n_{c}") > 0).alias("has_values")) for c in cols])))


def test_gate(df: DataFrame, group_col: str, metrics: Sequence[str], min_groups: int = 2,
              min_rows: int = 6) -> DataFrame:
    """Per metric: rows with a value and a group, distinct groups among them, and the gate
    ``groups >= 2 and rows >= 6`` that the statistics loop applies."""
    aggs = []
    for m in metrics:
        aggs.append(F.count(F.when(F.col(group_col).isNotNull(), F.col(m))).alias(f"n_{m}"))
        aggs.append(F.count_distinct(F.when(F.col(m).isNotNull(), F.col(group_col))).alias(f"g_{m}"))
    agg = df.agg(*aggs)
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("n_rows"), F.col(f"g_{m}").alias("n_groups"),
                 ((F.col(f"g_{m}") >= min_groups) & (F.col(f"n_{m}") >= min_rows)).alias("testable"))
        for m in metrics])))


def group_median(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Exact median per group (linear interpolation)."""
    return quantiles(df, metric, {"Median": 0.5}, keys)


def _beside_groups(rows: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows with the row of their group, NULL groups included: by broadcast behind a
    count of the groups, else as Spark decides."""
    right, n = frozen_small(renamed_keys(table, keys, "_g", values))
    return rows.join(F.broadcast(right) if n <= MOST_GROUPS else right, same_group(keys, "_g")).drop(*[f"_g{i}" for i in range(len(keys))])


def boxplot_stats(df: DataFrame, keys: Sequence[str], metric: str, coef: float = 1.5) -> DataFrame:
    """Per group: quartiles, whiskers (most extreme values inside the 1.5 IQR
    fences), the number of outliers and of values.  Outlier rows: ``boxplot_outliers``.
    A group of NULLs only keeps its row, with N = 0, and so does the group of NULL keys.
    The values are read three times and never shuffled but for those near a quartile."""
    keys = list(keys)
    q, _ = frozen_small(quantiles(df, metric, {"Q1": 0.25, "Median": 0.5, "Q3": 0.75}, keys))
    fences = [(F.col("Q1") - F.lit(coef) * (F.col("Q3") - F.col("Q1"))).alias("_from"), (F.col("Q3") + F.lit(coef) * (F.col("Q3") - F.col("Q1"))).alias("_to")]
    j = _beside_groups(df.where(F.col(metric).isNotNull()).select(*keys, metric), q, keys, fences)
    inside = (F.col(metric) >= F.col("_from")) & (F.col(metric) <= F.col("_to"))
    w = j.groupBy(*keys).agg(
        F.min(F.when(inside, F.col(metric))).alias("Lower_Whisker"),
        F.max(F.when(inside, F.col(metric))).alias("Upper_Whisker"),
        F.count_if(~inside).alias("N_Outliers"), F.count(F.lit(1)).alias("N"))
    w = renamed_keys(w, keys, "_w", ["Lower_Whisker", "Upper_Whisker", "N_Outliers", "N"])
    return q.join(w, same_group(keys, "_w"), "left").select(
        *q.columns, "Lower_Whisker", "Upper_Whisker", F.coalesce("N_Outliers", F.lit(0)).cast("long").alias("N_Outliers"),
        F.coalesce("N", F.lit(0)).cast("long").alias("N"))


def boxplot_outliers(df: DataFrame, keys: Sequence[str], metric: str, coef: float = 1.5) -> DataFrame:
    """The rows outside the whisker fences (as rows, never collected into a list)."""
    keys = list(keys)
    q = quantiles(df, metric, {"Q1": 0.25, "Q3": 0.75}, keys)
    iqr = F.col("Q3") - F.col("Q1")
    j = _beside_groups(df.where(F.col(metric).isNotNull()), q, keys, [(F.col("Q1") - F.lit(coef) * iqr).alias("_from"), (F.col("Q3") + F.lit(coef) * iqr).alias("_to")])
    return j.where((F.col(metric) < F.col("_from")) | (F.col(metric) > F.col("_to"))).drop("_from", "_to")


def correlation_matrix(df: DataFrame, metrics: Sequence[str], group_col: str | None = None,
                       all_label: str = "ALL") -> DataFrame:
    """Pearson r for every pair of metrics over the rows where both are present,
    overall and (with ``group_col``) per group.  Long format:
    ``group, metric_x, metric_y, n_pairs, r``."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1:]]

    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(a, b).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    if group_col:  # overall and per group in one pass
        agg = df.withColumn("_g", F.col(group_col).cast("string")).rollup("_g").agg(F.grouping("_g").alias("_whole"), *aggs)
        group = F.when(F.col("_whole") == 1, F.lit(all_label)).otherwise(F.col("_g"))
    else:
        agg, group = df.agg(*aggs), F.lit(all_label)
    return agg.select(group.alias("group"), F.inline(F.array(*[
        F.struct(F.lit(a).alias("metric_x"), F.lit(b).alias("metric_y"),
                 F.col(f"n{i}").alias("n_pairs"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])))


#: a box of values is so wide (in bandwidths), and reaches so far; with so many terms the
#: expansion of exp(t s), |t s| <= (REACH + WIDTH) * WIDTH / 2, leaves less than 1e-15
BOX_WIDTH, REACH, TERMS = 0.25, 8.5, 18


def density_curve(df: DataFrame, metric: str, group_col: str | Sequence[str], n_grid: int = 512, cut: float = 3.0,
                  panel: Sequence[str] | None = None) -> DataFrame:
    """Gaussian kernel density per group on ``n_grid`` points, bandwidth by Silverman's
    rule (nrd0).  Each group has its own grid, from min - cut * bw to max + cut * bw; with
    ``panel`` (some of the group columns, perhaps none) all groups of a panel share one,
    from the smallest to the largest value, as the curves of one chart do.

    The sums are those over all points, to an error below 1e-14 of the kernel's peak:
    values go into boxes of a quarter of a bandwidth, of which only the first ``TERMS`` moments
    are kept (a partial aggregate, whatever the number of rows); a box then adds its
    Taylor expansion to the grid points within ``REACH`` bandwidths, beyond which a
    kernel is below 1e-15.  Boxes that hold nothing do not exist.  Groups without a
    value have no curve."""
    keys = [group_col] if isinstance(group_col, str) else list(group_col)
    base = df.where(F.col(metric).isNotNull()).select(*keys, F.col(metric).cast("double").alias("_v"))
    q = quantiles(base, "_v", {"_q1": 0.25, "_q3": 0.75}, keys)
    st = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    st = st.join(renamed_keys(q, keys, "_j", [F.col("_q1").alias("_a"), F.col("_q3").alias("_b")]), same_group(keys, "_j"))
    lo = F.least(F.col("_sd"), (F.col("_b") - F.col("_a")) / F.lit(1.34))
    lo = F.when(lo > 0, lo).when(F.col("_sd") > 0, F.col("_sd")) \
        .when(F.abs(F.col("_min")) > 0, F.abs(F.col("_min"))).otherwise(F.lit(1.0))
    st = st.withColumn("bandwidth", F.lit(0.9) * lo * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    if panel is None:
        st = st.withColumn("_from", F.col("_min") - F.lit(cut) * F.col("bandwidth")).withColumn("_to", F.col("_max") + F.lit(cut) * F.col("bandwidth"))
    else:
        whole = Window.partitionBy(*panel)  # a row per group
        st = st.withColumn("_from", F.min("_min").over(whole)).withColumn("_to", F.max("_max").over(whole))
    st = st.withColumn("_step", (F.col("_to") - F.col("_from")) / F.lit(float(n_grid - 1)))
    st, _ = frozen_small(st.select(*keys, "_n", "_min", "bandwidth", "_from", "_step"))

    size = F.col("bandwidth") * F.lit(BOX_WIDTH)
    boxed = _beside_groups(base, st, keys, ["_min", "bandwidth"]).withColumn("_box", F.floor((F.col("_v") - F.col("_min")) / size).cast("long"))
    s = (F.col("_v") - F.col("_min") - (F.col("_box") + F.lit(0.5)) * size) / F.col("bandwidth")
    boxed = boxed.select(*keys, "_box", s.alias("_s")).withColumn("_e", F.exp(F.lit(-0.5) * F.col("_s") * F.col("_s")))
    moments, power = [], F.col("_e")
    for k in range(TERMS):
        moments.append(F.sum(power).alias(f"_m{k}"))
        power = power * F.col("_s") / F.lit(float(k + 1))
    boxes = boxed.groupBy(*keys, "_box").agg(*moments)

    near = _beside_groups(boxes, st, keys, ["_min", "bandwidth", "_from", "_step"])
    centre = F.col("_min") + (F.col("_box") + F.lit(0.5)) * F.col("bandwidth") * F.lit(BOX_WIDTH)
    near = near.withColumn("_c", centre)
    far = F.lit(REACH) * F.col("bandwidth")
    first = F.when(F.col("_step") > 0, F.greatest(F.ceil((F.col("_c") - far - F.col("_from")) / F.col("_step")), F.lit(0))).otherwise(F.lit(0)).cast("int")
    last = F.when(F.col("_step") > 0, F.least(F.floor((F.col("_c") + far - F.col("_from")) / F.col("_step")), F.lit(n_grid - 1))).otherwise(F.lit(n_grid - 1)).cast("int")
    # a box between two grid points that are far apart reaches none
    points = (near.withColumn("_first", first).withColumn("_last", last).where(F.col("_first") <= F.col("_last"))
              .withColumn("grid_index", F.explode(F.sequence("_first", "_last")))
              .withColumn("_t", (F.col("_from") + F.col("grid_index") * F.col("_step") - F.col("_c")) / F.col("bandwidth")))
    series = F.col(f"_m{TERMS - 1}")
    for k in range(TERMS - 2, -1, -1):
        series = series * F.col("_t") + F.col(f"_m{k}")
    sums = points.groupBy(*keys, "grid_index").agg(F.sum(F.exp(F.lit(-0.5) * F.col("_t") * F.col("_t")) * series).alias("_sum"))

    grid = st.withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
    right = renamed_keys(sums, keys, "_s", [F.col("grid_index").alias("_at"), "_sum"])
    norm = F.lit(1.0 / math.sqrt(2.0 * math.pi))
    return grid.join(right, same_group(keys, "_s") & (F.col("grid_index") == F.col("_at")), "left").select(
        *keys, "grid_index", (F.col("_from") + F.col("grid_index") * F.col("_step")).alias("x"), "bandwidth",
        (F.coalesce("_sum", F.lit(0.0)) * norm / (F.col("_n") * F.col("bandwidth"))).alias("density"))


def scatter_points(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Point data for a scatter chart (all rows; sample only when drawing)."""
    return df.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())


def class_count(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_distinct(label).alias("num_classes"))
