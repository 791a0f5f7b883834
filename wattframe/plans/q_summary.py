
from __future__ import annotations


from pyspark.sql import functions as F

from wattframe.operators import summary
from wattframe.plans import sql_tables as Q
from wattframe.plans import standins as SI
from wattframe.plans.catalog import query
from wattframe.plans.common import rounded

LAPTOP_METRICS = {"M2": "M2_Total_Energy_J", "M3": "M3_Execution_Time_s", "M4": "M4_Model_Accuracy",
                  "M5": "M5_Energy_Efficiency"}
BOARD_METRICS = ["M1_Avg_Power_W", "M2_Total_Energy_J", "M3_Exec_Time_s", "M5_Energy_Efficiency"]


@query("summary_two_keys", oracle=Q.with_(Q.LAPTOP) + """
SELECT Platform, Library_Name, count(*) AS N,
       round(avg(M2_Total_Energy_J), 8) AS Mean_M2, round(stddev_samp(M2_Total_Energy_J), 8) AS SD_M2,
       round(avg(M3_Execution_Time_s), 8) AS Mean_M3, round(stddev_samp(M3_Execution_Time_s), 8) AS SD_M3,
       round(avg(M4_Model_Accuracy), 8) AS Mean_M4, round(stddev_samp(M4_Model_Accuracy), 8) AS SD_M4,
       round(avg(M5_Energy_Efficiency), 10) AS Mean_M5, round(stddev_samp(M5_Energy_Efficiency), 10) AS SD_M5,
       round(avg(Accuracy_Pct), 8) AS Mean_Accuracy
FROM lm GROUP BY Platform, Library_Name""")
def summary_two_keys(spark, sf_dir):
    out = summary.summary_two_keys(SI.laptop_metrics(spark, sf_dir), ["Platform", "Library_Name"], LAPTOP_METRICS)
    digits = {c: (10 if "M5" in c else 8) for c in out.columns if c.startswith(("Mean_", "SD_"))}
    return rounded(out, digits)


@query("summary_one_key", oracle=Q.with_(Q.BOARD) + """
SELECT Library_Name, count(*) AS N,
       round(avg(M1_Avg_Power_W), 8) AS Mean_M1, round(avg(M2_Total_Energy_J), 8) AS Mean_M2,
       round(avg(M3_Exec_Time_s), 8) AS Mean_M3, round(avg(M5_Energy_Efficiency), 10) AS Mean_M5,
       round(avg(Precision_Pct), 8) AS Mean_Precision, round(avg(Accuracy_Pct), 8) AS Mean_Accuracy,
       round(avg(MSE), 8) AS Mean_MSE, round(avg(r2_score), 8) AS Mean_R2
FROM bm GROUP BY Library_Name""")
def summary_one_key(spark, sf_dir):
    out = summary.summary_one_key(SI.board_metrics(spark, sf_dir), "Library_Name", {
        "M1": "M1_Avg_Power_W", "M2": "M2_Total_Energy_J", "M3": "M3_Exec_Time_s", "M5": "M5_Energy_Efficiency",
        "Precision": "Precision_Pct", "Accuracy": "Accuracy_Pct", "MSE": "MSE", "R2": "r2_score"})
    digits = {c: (10 if c == "Mean_M5" else 8) for c in out.columns if c.startswith("Mean_")}
    return rounded(out, digits)


@query("group_median", oracle=Q.with_(Q.LAPTOP) + """
SELECT Platform, Library_Name, round(median(M2_Total_Energy_J), 8) AS Median FROM lm GROUP BY ALL""")
def group_median(spark, sf_dir):
    out = summary.group_median(SI.laptop_metrics(spark, sf_dir), ["Platform", "Library_Name"], "M2_Total_Energy_J")
    return rounded(out, {"Median": 8})


@query("group_median_all", oracle=Q.with_(Q.LAPTOP) + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, Platform, Library_Name, round(median({c}), 8) AS Median FROM lm GROUP BY ALL" for c in LAPTOP_METRICS.values()))
def group_median_all(spark, sf_dir):
    """Medians of every laptop metric."""
    metrics = list(LAPTOP_METRICS.values())
    long = (SI.laptop_metrics(spark, sf_dir).select("Platform", "Library_Name", *[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot(["Platform", "Library_Name"], metrics, "metric", "value"))
    return rounded(summary.group_median(long, ["metric", "Platform", "Library_Name"], "value"), {"Median": 8})


@query("group_mean_all", oracle=Q.with_(Q.LAPTOP) + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, Platform, Library_Name, round(avg({c}), 8) AS Mean, printf('%.2f', avg({c})) AS label FROM lm GROUP BY ALL"
    for c in LAPTOP_METRICS.values()))
def group_mean_all(spark, sf_dir):
    """Bars of every laptop metric."""
    metrics = list(LAPTOP_METRICS.values())
    long = (SI.laptop_metrics(spark, sf_dir).select("Platform", "Library_Name", *[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot(["Platform", "Library_Name"], metrics, "metric", "value"))
    return rounded(summary.group_mean(long, ["metric", "Platform", "Library_Name"], "value", "fixed2"), {"Mean": 8})


@query("group_mean", oracle=Q.with_(Q.BOARD) + """
SELECT Library_Name, round(avg(M2_Total_Energy_J), 8) AS Mean, printf('%.2f', avg(M2_Total_Energy_J)) AS label
FROM bm GROUP BY Library_Name""")
def group_mean(spark, sf_dir):
    out = summary.group_mean(SI.board_metrics(spark, sf_dir), ["Library_Name"], "M2_Total_Energy_J", "fixed2")
    return rounded(out, {"Mean": 8})


@query("axis_headroom", oracle=Q.with_(Q.BOARD) + """
SELECT round(max(m) * 1.1, 8) AS y_limit FROM (SELECT avg(M3_Exec_Time_s) AS m FROM bm GROUP BY Library_Name)""")
def axis_headroom(spark, sf_dir):
    means = summary.group_mean(SI.board_metrics(spark, sf_dir), ["Library_Name"], "M3_Exec_Time_s")
    return rounded(summary.axis_headroom(means), {"y_limit": 8})


@query("non_null_count", oracle=Q.with_(Q.BOARD) + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, count({c}) AS n_present, count({c}) > 0 AS has_values FROM bm"
    for c in ["Accuracy_Pct", "Precision_Pct", "MSE", "r2_score", "M5_Energy_Efficiency"]))
def non_null_count(spark, sf_dir):
    return summary.non_null_count(SI.board_metrics(spark, sf_dir),
                                  ["Accuracy_Pct", "Precision_Pct", "MSE", "r2_score", "M5_Energy_Efficiency"])


@query("test_gate", oracle=Q.with_(Q.BOARD) + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, count({c}) AS n_rows, count(DISTINCT CASE WHEN {c} IS NOT NULL THEN Library_Name END)"
    f" AS n_groups, count(DISTINCT CASE WHEN {c} IS NOT NULL THEN Library_Name END) >= 2 AND count({c}) >= 6"
    f" AS testable FROM bm" for c in BOARD_METRICS))
def test_gate(spark, sf_dir):
    return summary.test_gate(SI.board_metrics(spark, sf_dir), "Library_Name", BOARD_METRICS)


@query("boxplot_stats", oracle=Q.with_(Q.LAPTOP) + """,
q AS (SELECT Platform, Library_Name, quantile_cont(M2_Total_Energy_J, 0.25) AS Q1,
             quantile_cont(M2_Total_Energy_J, 0.5) AS Median, quantile_cont(M2_Total_Energy_J, 0.75) AS Q3
      FROM lm GROUP BY ALL),
j AS (SELECT Platform, Library_Name, M2_Total_Energy_J AS v,
             v >= Q1 - 1.5 * (Q3 - Q1) AND v <= Q3 + 1.5 * (Q3 - Q1) AS inside
      FROM lm JOIN q USING (Platform, Library_Name))
SELECT Platform, Library_Name, round(Q1, 8) AS Q1, round(Median, 8) AS Median, round(Q3, 8) AS Q3,
       round(Lower_Whisker, 8) AS Lower_Whisker, round(Upper_Whisker, 8) AS Upper_Whisker, N_Outliers, N
FROM q JOIN (SELECT Platform, Library_Name, min(v) FILTER (WHERE inside) AS Lower_Whisker,
                    max(v) FILTER (WHERE inside) AS Upper_Whisker, count(*) FILTER (WHERE NOT inside) AS N_Outliers,
                    count(*) AS N
             FROM j GROUP BY ALL) USING (Platform, Library_Name)""")
def boxplot_stats(spark, sf_dir):
    out = summary.boxplot_stats(SI.laptop_metrics(spark, sf_dir), ["Platform", "Library_Name"], "M2_Total_Energy_J")
    return rounded(out, {c: 8 for c in ["Q1", "Median", "Q3", "Lower_Whisker", "Upper_Whisker"]})


_CORR_COLS = list(LAPTOP_METRICS.values())


def _corr_sql():
    pairs = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]
    parts = []
    for grp, gb in (("'ALL'", ""), ("Library_Name", " GROUP BY Library_Name")):
        for a, b in pairs:
            parts.append(f"SELECT {grp} AS \"group\", '{a}' AS metric_x, '{b}' AS metric_y, "
                         f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_pairs, "
                         f"round(corr({a}, {b}), 8) AS r FROM lm{gb}")
    return Q.with_(Q.LAPTOP) + " UNION ALL ".join(parts)


@query("correlation_matrix", oracle=_corr_sql())
def correlation_matrix(spark, sf_dir):
    out = summary.correlation_matrix(SI.laptop_metrics(spark, sf_dir), _CORR_COLS, "Library_Name")
    return rounded(out, {"r": 8})


def _density_sql(rows: str, shared: bool) -> str:
    """The sum over all points; ``rows`` gives (m, g, v)."""
    ends = "min(mn) OVER (PARTITION BY m) AS fr, max(mx) OVER (PARTITION BY m) AS til" if shared else "mn - 3.0 * bw AS fr, mx + 3.0 * bw AS til"
    return f""",
t AS (SELECT * FROM ({rows}) WHERE v IS NOT NULL),
st AS (SELECT m, g, count(*) AS n, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx,
              quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM t GROUP BY ALL),
b1 AS (SELECT *, least(sd, (q3 - q1) / 1.34) AS lo0 FROM st),
b2 AS (SELECT *, 0.9 * (CASE WHEN lo0 > 0 THEN lo0 WHEN sd > 0 THEN sd WHEN abs(mn) > 0 THEN abs(mn) ELSE 1.0 END)
                 * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM b1),
p AS (SELECT *, {ends} FROM b2),
x AS (SELECT m, g, n, bw, gi, fr + gi * ((til - fr) / 511.0) AS x FROM p CROSS JOIN range(0, 512) r(gi)),
d AS (SELECT m, g, v, count(*) AS c FROM t GROUP BY ALL),
k AS (SELECT x.m, x.g, gi, x, bw, n, sum(c * exp(-0.5 * pow((x - v) / bw, 2))) AS s
      FROM x JOIN d ON d.m IS NOT DISTINCT FROM x.m AND d.g IS NOT DISTINCT FROM x.g GROUP BY ALL)
"""


@query("density_curve", oracle=Q.with_(Q.LAPTOP) + _density_sql("SELECT 1 AS m, Library_Name AS g, M2_Total_Energy_J AS v FROM lm", False) + """
SELECT g AS Library_Name, CAST(gi AS INTEGER) AS grid_index, round(x, 8) AS x, round(bw, 10) AS bandwidth,
       round(s / sqrt(2.0 * pi()) / (n * bw), 10) AS density FROM k""")
def density_curve(spark, sf_dir):
    out = summary.density_curve(SI.laptop_metrics(spark, sf_dir), "M2_Total_Energy_J", "Library_Name")
    return rounded(out, {"x": 8, "bandwidth": 10, "density": 10})


@query("density_curves_all", oracle=Q.with_(Q.LAPTOP) + _density_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS m, Library_Name AS g, {c} AS v FROM lm" for c in LAPTOP_METRICS.values()), True) + """
SELECT m AS metric, g AS Library_Name, CAST(gi AS INTEGER) AS grid_index, round(x, 8) AS x, round(bw, 9) AS bandwidth,
       round(s / sqrt(2.0 * pi()) / (n * bw), 8) AS density FROM k""")
def density_curves_all(spark, sf_dir):
    """Curves of every laptop metric; the groups of a metric share its grid."""
    metrics = list(LAPTOP_METRICS.values())
    long = (SI.laptop_metrics(spark, sf_dir).select("Library_Name", *[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot(["Library_Name"], metrics, "metric", "value"))
    out = summary.density_curve(long, "value", ["metric", "Library_Name"], panel=["metric"])
    return rounded(out, {"x": 8, "bandwidth": 9, "density": 8})


@query("scatter_points", oracle=Q.with_(Q.LAPTOP) + """
SELECT Platform, Library_Name, M2_Total_Energy_J AS x, M4_Model_Accuracy AS y FROM lm
WHERE M2_Total_Energy_J IS NOT NULL AND M4_Model_Accuracy IS NOT NULL""")
def scatter_points(spark, sf_dir):
    return summary.scatter_points(SI.laptop_metrics(spark, sf_dir), "M2_Total_Energy_J", "M4_Model_Accuracy",
                                  ["Platform", "Library_Name"])


@query("boxplot_outliers", oracle=Q.with_(Q.LAPTOP) + """,
q AS (SELECT Platform, Library_Name, quantile_cont(M5_Energy_Efficiency, 0.25) AS Q1,
             quantile_cont(M5_Energy_Efficiency, 0.75) AS Q3 FROM lm GROUP BY ALL)
SELECT l_orderkey, l_linenumber, Platform, Library_Name, M5_Energy_Efficiency
FROM lm JOIN q USING (Platform, Library_Name)
WHERE M5_Energy_Efficiency < Q1 - 1.5 * (Q3 - Q1) OR M5_Energy_Efficiency > Q3 + 1.5 * (Q3 - Q1)""")
def boxplot_outliers(spark, sf_dir):
    m = SI.laptop_metrics(spark, sf_dir).select("l_orderkey", "l_linenumber", "Platform", "Library_Name",
                                                 "M5_Energy_Efficiency")
    return summary.boxplot_outliers(m, ["Platform", "Library_Name"], "M5_Energy_Efficiency")


@query("boxplot_stats_all", oracle=Q.with_(Q.LAPTOP) + """,
u AS (UNPIVOT (SELECT Platform, Library_Name, %s FROM lm) ON %s INTO NAME metric VALUE v),
q AS (SELECT metric, Platform, Library_Name, quantile_cont(v, 0.25) AS Q1, quantile_cont(v, 0.5) AS Median, quantile_cont(v, 0.75) AS Q3
      FROM u GROUP BY ALL),
j AS (SELECT u.*, v >= Q1 - 1.5 * (Q3 - Q1) AND v <= Q3 + 1.5 * (Q3 - Q1) AS inside FROM u JOIN q USING (metric, Platform, Library_Name))
SELECT metric, Platform, Library_Name, round(Q1, 8) AS Q1, round(Median, 8) AS Median, round(Q3, 8) AS Q3,
       round(Lower_Whisker, 8) AS Lower_Whisker, round(Upper_Whisker, 8) AS Upper_Whisker, N_Outliers, N
FROM q JOIN (SELECT metric, Platform, Library_Name, min(v) FILTER (WHERE inside) AS Lower_Whisker,
                    max(v) FILTER (WHERE inside) AS Upper_Whisker, count(*) FILTER (WHERE NOT inside) AS N_Outliers,
                    count(*) AS N FROM j GROUP BY ALL) USING (metric, Platform, Library_Name)""" % (
    ", ".join(LAPTOP_METRICS.values()), ", ".join(LAPTOP_METRICS.values())))
def boxplot_stats_all(spark, sf_dir):
    """Box data of every laptop metric in one pass over the table."""
    metrics = list(LAPTOP_METRICS.values())
    long = (SI.laptop_metrics(spark, sf_dir).select("Platform", "Library_Name", *metrics)
            .unpivot(["Platform", "Library_Name"], metrics, "metric", "value").where(F.col("value").isNotNull()))
    out = summary.boxplot_stats(long, ["metric", "Platform", "Library_Name"], "value")
    return rounded(out, {c: 8 for c in ["Q1", "Median", "Q3", "Lower_Whisker", "Upper_Whisker"]})


_BOARD_CORR = ["M1_Avg_Power_W", "M2_Total_Energy_J", "M3_Exec_Time_s", "M5_Energy_Efficiency", "Accuracy_Pct", "Precision_Pct"]


@query("correlation_matrix_board", oracle=Q.with_(Q.BOARD) + " UNION ALL ".join(
    f"SELECT 'ALL' AS \"group\", '{a}' AS metric_x, '{b}' AS metric_y, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_pairs, "
    f"round(corr({a}, {b}), 8) AS r FROM bm" for i, a in enumerate(_BOARD_CORR) for b in _BOARD_CORR[i + 1:]))
def correlation_matrix_board(spark, sf_dir):
    return rounded(summary.correlation_matrix(SI.board_metrics(spark, sf_dir), _BOARD_CORR), {"r": 8})


@query("scatter_pairs", oracle=Q.with_(Q.LAPTOP) + " UNION ALL ".join(
    f"SELECT Platform, Library_Name, '{a}' AS metric_x, '{b}' AS metric_y, {a} AS x, {b} AS y FROM lm WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]))
def scatter_pairs(spark, sf_dir):
    """Points of every pair of laptop metrics, one read of the table."""
    pairs = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]
    points = SI.laptop_metrics(spark, sf_dir).select("Platform", "Library_Name", F.inline(F.array(*[
        F.struct(F.lit(a).alias("metric_x"), F.lit(b).alias("metric_y"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in pairs])))
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
