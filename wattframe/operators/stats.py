"""ANOVA and Kruskal-Wallis as grouped Spark jobs.

Rows are reduced to per-group moments (n, mean, sample variance; Spark's
central-moment aggregates are numerically stable) or per-value counts before
anything is combined, so the final algebra runs on a table with one row per
group or cell.  Ranks come from the bucketed ``value_counts_ranked``; no window
ever covers all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattframe.functions.pvalues import chi2_pvalue, f_pvalue
from wattframe.operators.ranking import value_counts_ranked
from wattframe.session import ensure_checkpoint_dir

INSUFFICIENT = "too few rows or groups to test"
#: up to so many levels of the smaller factor a two-way ANOVA solves a square matrix of them on
#: the driver; beyond, it solves the same equations by conjugate gradients on tables
DENSE_LEVELS = 1_000
CG_TOLERANCE = 1e-11


def _complete(df: DataFrame, value: str, group_cols: Sequence[str]) -> DataFrame:
    for c in (value, *group_cols):
        df = df.where(F.col(c).isNotNull())
    return df


def group_moments(df: DataFrame, value: str, group_cols: Sequence[str]) -> DataFrame:
    """(groups, n, mean, var) of the rows with a value and a group; a row without
    one of its factors is left out, as R's model functions do."""
    return (_complete(df, value, group_cols).groupBy(*group_cols)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                 F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var")))


def anova_one_way(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way ANOVA of ``value`` by ``group`` (per ``by`` partition).

    SS_between = sum n_g (mean_g - grand)^2, SS_within = sum (n_g - 1) var_g."""
    return anova_from_moments(group_moments(df, value, [*by, group]), by)


def anova_from_moments(g: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-way ANOVA from a per-group moment table (n, mean, var) - one row per
    (``by`` partition, group)."""
    by = list(by)
    w = Window.partitionBy(*by)
    g = g.withColumn("_grand", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    out = g.groupBy(*by).agg(
        (F.count(F.lit(1)) - 1).alias("df_between"),
        (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) ** 2).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"),
    )
    ms_b = F.try_divide(F.col("ss_between"), F.col("df_between"))
    ms_w = F.try_divide(F.col("ss_within"), F.col("df_within"))
    return (out.withColumn("ms_between", ms_b).withColumn("ms_within", ms_w)
            .withColumn("f_value", F.try_divide(F.col("ms_between"), F.col("ms_within"))))


def with_f_pvalue(df: DataFrame, f_col: str = "f_value", d1: str = "df_between", d2: str = "df_within",
                  out: str = "p_value") -> DataFrame:
    return df.withColumn(out, f_pvalue(F.col(f_col).cast("double"), F.col(d1).cast("double"), F.col(d2).cast("double")))


def kruskal(df: DataFrame, value: str, group_cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Kruskal-Wallis H with tie correction, per ``by`` partition; groups are
    the combinations of ``group_cols`` (an interaction when there are several).

    H = 12 / (N (N + 1)) * sum n_g (mean rank_g - (N + 1) / 2)^2, divided by
    1 - sum (t^3 - t) / (N^3 - N); df = groups - 1.  Ranks are centred before they
    are summed, so no digits are lost to a difference of large numbers."""
    by, group_cols = list(by), list(group_cols)
    base = _complete(df, value, group_cols)
    whole = not by
    if whole:  # one partition key for everything, so every join below is an equi-join
        base, by = base.withColumn("_all", F.lit(0)), ["_all"]
    # one row per (partition, group, value) with the value's mid-rank over the partition
    r = value_counts_ranked(base, value, by, carry_cols=group_cols)
    # sum over values of t^3 - t  ==  sum over rows of n_c * (t^2 - 1): folded into the same aggregates
    t = F.col("n_ties").cast("double")
    centre = (F.col("n_group") + F.lit(1)) / F.lit(2.0)
    per_group = r.groupBy(*by, *group_cols).agg(
        F.sum("n_c").alias("_n"), F.sum(F.col("n_c") * (F.col("mid_rank") - centre)).alias("_r"),
        F.sum(F.col("n_c").cast("double") * (t * t - F.lit(1.0))).alias("_tg"))
    out = per_group.groupBy(*by).agg(F.sum(F.col("_r") ** 2 / F.col("_n")).alias("_s"),
                                     F.count(F.lit(1)).alias("_k"), F.sum("_tg").alias("_t"),
                                     F.sum("_n").alias("_N"))
    n = F.col("_N").cast("double")
    h_raw = F.lit(12.0) / (n * (n + 1)) * F.col("_s")
    corr = F.lit(1.0) - F.try_divide(F.col("_t"), n * n * n - n)
    keys = [] if whole else by
    return out.select(*keys, F.col("_N").cast("long").alias("n"), (F.col("_k") - 1).cast("long").alias("kruskal_df"),
                      F.try_divide(h_raw, corr).alias("kruskal_h"))


def with_chi2_pvalue(df: DataFrame, x_col: str = "kruskal_h", k_col: str = "kruskal_df",
                     out: str = "kruskal_p") -> DataFrame:
    return df.withColumn(out, chi2_pvalue(F.col(x_col).cast("double"), F.col(k_col).cast("double")))


def _dense_gain(c: DataFrame, joined: DataFrame, right: list, many: str, few: str) -> float:
    """What the smaller factor adds to the larger one's sum of squares; ``right`` has a
    row (diagonal d, right side r) for each of its levels."""
    pairs = (joined.select(F.col(many), F.col(few).alias("i"), F.col("n").alias("ni"), "nm")
             .join(c.select(F.col(many), F.col(few).alias("j"), F.col("n").alias("nj")), many)
             .groupBy("i", "j").agg(F.sum(F.col("ni") * F.col("nj") / F.col("nm")).alias("x")).collect())
    place = {r[few]: k for k, r in enumerate(sorted(right, key=lambda r: str(r[few])))}
    lhs, rhs = np.zeros((len(place), len(place))), np.zeros(len(place))
    for r in right:
        lhs[place[r[few]], place[r[few]]] += r["d"]
        rhs[place[r[few]]] = r["r"]
    for r in pairs:
        lhs[place[r["i"]], place[r["j"]]] -= r["x"]
    return float(rhs @ np.linalg.lstsq(lhs, rhs, rcond=None)[0])


def _iterative_gain(cells: DataFrame, levels: DataFrame, tolerance: float = CG_TOLERANCE, most: int = 1_000) -> float:
    """The same by conjugate gradients with the diagonal as preconditioner. ``cells`` has
    (many, few, n, nm: rows of the larger factor's level), ``levels`` (few, d, r). A step
    is two joins of the cells with a vector and two sums; vectors are checkpointed
    tables of a row per level. Ends when r'D^-1 r, the gain that is still missing at
    most times the condition, has fallen by ``tolerance`` squared; an error after ``most`` steps."""
    cells = cells.checkpoint(eager=True)
    # x: solution, r: residual, p: direction
    v = levels.select("few", "d", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("d")).alias("p")).checkpoint(eager=True)
    first = rho = v.agg(F.sum(F.col("r") ** 2 / F.col("d"))).first()[0] or 0.0
    for _ in range(most):
        if rho <= tolerance**2 * first:
            break
        over = (cells.join(v.select(F.col("few").alias("at"), "p"), F.col("few") == F.col("at"))
                .groupBy("many").agg((F.sum(F.col("n") * F.col("p")) / F.first("nm")).alias("t")))
        back = (cells.select("many", "few", "n").join(over.withColumnRenamed("many", "of"), F.col("many") == F.col("of"))
                .groupBy("few").agg(F.sum(F.col("n") * F.col("t")).alias("s")).withColumnRenamed("few", "at"))
        step = v.join(back, F.col("few") == F.col("at")).select("few", "d", "x", "r", "p", (F.col("d") * F.col("p") - F.col("s")).alias("q")).checkpoint(eager=True)
        curve = step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not curve > 0:
            break  # the direction adds nothing: only a constant is left
        alpha = rho / curve
        step = step.withColumn("x", F.col("x") + F.lit(alpha) * F.col("p")).withColumn("r", F.col("r") - F.lit(alpha) * F.col("q"))
        new = step.agg(F.sum(F.col("r") ** 2 / F.col("d"))).first()[0]
        v = step.select("few", "d", "x", "r", (F.col("r") / F.col("d") + F.lit(new / rho) * F.col("p")).alias("p")).checkpoint(eager=True)
        rho = new
    else:
        raise RuntimeError(f"no convergence after {most} steps")
    return float(v.join(levels.select(F.col("few").alias("at"), F.col("r").alias("rhs")), F.col("few") == F.col("at"))
                 .agg(F.sum(F.col("x") * F.col("rhs"))).first()[0] or 0.0)


def anova_two_way(spark: SparkSession, df: DataFrame, value: str, a: str, b: str, dense_levels: int = DENSE_LEVELS) -> DataFrame:
    """Two-way ANOVA with interaction, sequential (type I) sums of squares in
    the order A, B, A:B - unequal cell sizes allowed.

    One grouped job gives the cell table (n, mean, var per (A, B) cell), which is
    checkpointed.  The additive model is fitted on it with the effects of the
    factor that has more levels eliminated in closed form. What is left, equations over
    the levels of the smaller factor, is solved on the driver up to ``DENSE_LEVELS``
    levels, and beyond by conjugate gradients whose vectors are tables, so both
    factors may have any number of levels."""
    ensure_checkpoint_dir(spark)
    cells = (group_moments(df, value, [a, b])
             .select(F.col(a).alias("a"), F.col(b).alias("b"), F.col("n").cast("double").alias("n"), "mean", "var")
             .checkpoint(eager=True))
    total = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"),
                      F.sum((F.col("n") - 1) * F.col("var")).alias("e")).first()
    if not total["cells"]:
        raise ValueError("no rows")
    c = cells.withColumn("y", F.col("mean") - F.lit(total["m"]))

    def levels_ss(key):
        per = c.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("s"))
        return per.agg(F.count(F.lit(1)), F.sum(F.col("s") ** 2 / F.col("n"))).first()

    (n_a, ss_a), (n_b, ss_b_alone) = levels_ss("a"), levels_ss("b")
    many, few = ("a", "b") if n_a >= n_b else ("b", "a")
    # normal equations of the smaller factor after the larger one: (D - N' M^-1 N) g = r
    per_many = c.groupBy(many).agg(F.sum("n").alias("nm"), F.sum(F.col("n") * F.col("y")).alias("sm"))
    joined = c.join(per_many, many)
    right = joined.groupBy(few).agg(F.sum("n").alias("d"), F.sum(F.col("n") * (F.col("y") - F.col("sm") / F.col("nm"))).alias("r"))
    if min(n_a, n_b) <= dense_levels:
        gain = _dense_gain(c, joined, right.collect(), many, few)
    else:
        gain = _iterative_gain(joined.select(F.col(many).alias("many"), F.col(few).alias("few"), "n", "nm"),
                               right.select(F.col(few).alias("few"), "d", "r"))
    ss_add = (ss_a if many == "a" else ss_b_alone) + gain
    ss_cells = c.agg(F.sum(F.col("n") * F.col("y") ** 2)).first()[0]
    df_a, df_b, df_ab = n_a - 1, n_b - 1, total["cells"] - n_a - n_b + 1
    df_e = int(total["n"]) - total["cells"]
    ms_e = total["e"] / df_e if df_e > 0 else None
    rows = []
    for term, dfx, ss in ((a, df_a, ss_a), (b, df_b, ss_add - ss_a), (f"{a}:{b}", df_ab, ss_cells - ss_add)):
        ms = float(ss) / dfx if dfx > 0 else None
        fval = ms / ms_e if ms is not None and ms_e else None
        rows.append((term, int(dfx), float(ss), ms, fval))
    rows.append(("Residuals", int(df_e), float(total["e"]), ms_e, None))
    return spark.createDataFrame(rows, "term string, df long, ss double, ms double, f_value double")


def stat_tests_all(df: DataFrame, metrics: Sequence[str], group: str, min_groups: int = 2,
                   min_rows: int = 6, with_p: bool = False) -> DataFrame:
    """The analysis loop as one job: metrics are unpivoted to (metric, value),
    NULLs dropped, the gate applied per metric, then ANOVA F and Kruskal H per
    metric.  Untestable metrics keep their counts and get the message."""
    long = (df.select(group, *metrics)
            .unpivot([group], list(metrics), "metric", "value")
            .where(F.col("value").isNotNull() & F.col(group).isNotNull()))
    # one grouped pass gives the moments for ANOVA and the counts for the gate
    moments = group_moments(long, "value", ["metric", group])
    an = (anova_from_moments(moments, ["metric"])
          .select("metric", (F.col("df_between") + 1).alias("n_groups"),
                  (F.col("df_within") + F.col("df_between") + 1).alias("n_rows"),
                  "df_between", "df_within", "f_value"))
    # every requested metric gets a row, also one without any value
    names = df.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    gate = (names.join(an, "metric", "left")
            .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
            .withColumn("n_groups", F.coalesce("n_groups", F.lit(0)).cast("long"))
            .withColumn("testable", (F.col("n_groups") >= min_groups) & (F.col("n_rows") >= min_rows)))
    kw = kruskal(long, "value", [group], by=["metric"]).select("metric", "kruskal_h", "kruskal_df")
    res = gate.join(kw, "metric", "left")
    if with_p:
        res = with_chi2_pvalue(with_f_pvalue(res, out="anova_p"))
    t = F.col("testable")
    cols = [F.col("metric"), F.col("n_rows"), F.col("n_groups"), t]
    keep = ["df_between", "df_within", "f_value", "kruskal_h", "kruskal_df"] + (["anova_p", "kruskal_p"] if with_p else [])
    cols += [F.when(t, F.col(c)).alias(c) for c in keep]
    cols.append(F.when(t, F.lit("tested")).otherwise(F.lit(INSUFFICIENT)).alias("result"))
    return res.select(*cols)
