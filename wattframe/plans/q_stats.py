
from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.operators import stats
from wattframe.plans import sql_tables as Q
from wattframe.plans import standins as SI
from wattframe.plans.catalog import query
from wattframe.plans.common import rounded

BOARD_TESTED = ["M1_Avg_Power_W", "M2_Total_Energy_J", "M3_Exec_Time_s", "M5_Energy_Efficiency"]


def _anova_sql(table: str, value: str, group: str) -> str:
    """Per-metric one-way ANOVA from group moments (subquery text)."""
    return f"""(
  WITH g AS (SELECT {group} AS grp, count(*) AS n, avg({value}) AS m, coalesce(var_samp({value}), 0) AS v
             FROM {table} WHERE {value} IS NOT NULL GROUP BY {group}),
  t AS (SELECT sum(n * m) / sum(n) AS grand FROM g)
  SELECT CAST(count(*) - 1 AS BIGINT) AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within,
         sum(n * (m - grand) * (m - grand)) AS ss_between, sum((n - 1) * v) AS ss_within,
         (sum(n * (m - grand) * (m - grand)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f_value
  FROM g, t)"""


def _kruskal_sql(table: str, value: str, group_expr: str) -> str:
    """Kruskal-Wallis H with tie correction (subquery text)."""
    return f"""(
  WITH t AS (SELECT {group_expr} AS grp, {value} AS v FROM {table} WHERE {value} IS NOT NULL),
  r AS (SELECT grp, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS mr FROM t),
  g AS (SELECT grp, count(*) AS n, sum(mr) AS rs FROM r GROUP BY grp),
  ties AS (SELECT CAST(count(*) AS DOUBLE) AS tc FROM t GROUP BY v),
  tot AS (SELECT CAST(count(*) AS DOUBLE) AS nn FROM t)
  SELECT CAST(nn AS BIGINT) AS n, CAST((SELECT count(*) FROM g) - 1 AS BIGINT) AS kruskal_df,
         (12.0 / (nn * (nn + 1)) * (SELECT sum(rs * rs / n) FROM g) - 3.0 * (nn + 1))
           / (1.0 - (SELECT sum(tc * tc * tc - tc) FROM ties) / (nn * nn * nn - nn)) AS kruskal_h
  FROM tot)"""


@query("anova_one_way", oracle=Q.with_(Q.BOARD) + f"""
SELECT df_between, df_within, round(ss_between, 6) AS ss_between, round(ss_within, 4) AS ss_within,
       round(f_value, 8) AS f_value
FROM {_anova_sql('bm', 'M2_Total_Energy_J', 'Library_Name')}""")
def anova_one_way(spark, sf_dir):
    out = stats.anova_one_way(SI.board_metrics(spark, sf_dir), "M2_Total_Energy_J", "Library_Name")
    return rounded(out.select("df_between", "df_within", "ss_between", "ss_within", "f_value"),
                   {"ss_between": 6, "ss_within": 4, "f_value": 8})


@query("anova_two_way", oracle=Q.with_(Q.LAPTOP) + """,
c AS (SELECT Library_Name AS a, Platform AS b, count(*) AS n, avg(M2_Total_Energy_J) AS m,
             coalesce(var_samp(M2_Total_Energy_J), 0) AS v
      FROM lm WHERE M2_Total_Energy_J IS NOT NULL GROUP BY ALL),
g AS (SELECT sum(n * m) / sum(n) AS grand, sum(n) AS nn, count(*) AS cells FROM c),
ma AS (SELECT a, sum(n) AS na, sum(n * m) / sum(n) AS mean_a FROM c GROUP BY a),
mb AS (SELECT b, sum(n) AS nb, sum(n * m) / sum(n) AS mean_b FROM c GROUP BY b),
sa AS (SELECT sum(na * (mean_a - grand) * (mean_a - grand)) AS ss_a, count(*) - 1 AS df_a FROM ma, g),
sb AS (SELECT sum(nb * (mean_b - grand) * (mean_b - grand)) AS ss_b_alone, count(*) - 1 AS df_b FROM mb, g),
pr AS (SELECT c1.n * c2.n / (c1.n + c2.n) AS w, c1.m - c2.m AS d
       FROM c c1 JOIN c c2 ON c1.b = c2.b AND c1.a = 'F' AND c2.a = 'O'),
sab AS (SELECT (sum(w * d) * sum(w * d)) / sum(w) AS ss_a_given_b FROM pr),
cl AS (SELECT sum(n * (m - grand) * (m - grand)) AS ss_cells, sum((n - 1) * v) AS ss_e FROM c, g),
terms AS (
  SELECT 'Library_Name' AS term, df_a AS df, ss_a AS ss FROM sa
  UNION ALL SELECT 'Platform', df_b, ss_b_alone + ss_a_given_b - ss_a FROM sb, sab, sa
  UNION ALL SELECT 'Library_Name:Platform', cells - (SELECT count(*) FROM ma) - (SELECT count(*) FROM mb) + 1,
                   ss_cells - (ss_b_alone + ss_a_given_b) FROM cl, sb, sab, g
  UNION ALL SELECT 'Residuals', nn - cells, ss_e FROM cl, g),
res AS (SELECT ss / df AS ms_e FROM terms WHERE term = 'Residuals')
SELECT term, CAST(df AS BIGINT) AS df, round(ss, 4) AS ss, round(ss / df, 6) AS ms,
       round(CASE WHEN term = 'Residuals' THEN NULL ELSE (ss / df) / ms_e END, 6) AS f_value
FROM terms, res""")
def anova_two_way(spark, sf_dir):
    out = stats.anova_two_way(spark, SI.laptop_metrics(spark, sf_dir), "M2_Total_Energy_J", "Library_Name", "Platform")
    return rounded(out, {"ss": 4, "ms": 6, "f_value": 6})


@query("kruskal_one_factor", oracle=Q.with_(Q.BOARD) + f"""
SELECT n, kruskal_df, round(kruskal_h, 6) AS kruskal_h FROM {_kruskal_sql('bm', 'M2_Total_Energy_J', 'Library_Name')}""")
def kruskal_one_factor(spark, sf_dir):
    out = stats.kruskal(SI.board_metrics(spark, sf_dir), "M2_Total_Energy_J", ["Library_Name"])
    return rounded(out, {"kruskal_h": 6})


@query("kruskal_interaction", oracle=Q.with_(Q.LAPTOP) + f"""
SELECT n, kruskal_df, round(kruskal_h, 6) AS kruskal_h
FROM {_kruskal_sql('lm', 'M3_Execution_Time_s', "Library_Name || '.' || Platform")}""")
def kruskal_interaction(spark, sf_dir):
    out = stats.kruskal(SI.laptop_metrics(spark, sf_dir), "M3_Execution_Time_s", ["Library_Name", "Platform"])
    return rounded(out, {"kruskal_h": 6})


def _stat_tests_sql():
    parts = []
    for m in BOARD_TESTED:
        parts.append(f"""
SELECT '{m}' AS metric, g.n_rows, g.n_groups, g.testable,
       CASE WHEN g.testable THEN a.df_between END AS df_between, CASE WHEN g.testable THEN a.df_within END AS df_within,
       CASE WHEN g.testable THEN round(a.f_value, 8) END AS f_value,
       CASE WHEN g.testable THEN round(k.kruskal_h, 6) END AS kruskal_h,
       CASE WHEN g.testable THEN k.kruskal_df END AS kruskal_df,
       CASE WHEN g.testable THEN 'tested' ELSE '{stats.INSUFFICIENT}' END AS result
FROM (SELECT count({m}) AS n_rows, count(DISTINCT CASE WHEN {m} IS NOT NULL THEN Library_Name END) AS n_groups,
             count(DISTINCT CASE WHEN {m} IS NOT NULL THEN Library_Name END) >= 2 AND count({m}) >= 6 AS testable
      FROM bm) g,
     {_anova_sql('bm', m, 'Library_Name')} a,
     {_kruskal_sql('bm', m, 'Library_Name')} k""")
    return Q.with_(Q.BOARD) + " UNION ALL ".join(parts)


@query("stat_tests_all", oracle=_stat_tests_sql())
def stat_tests_all(spark, sf_dir):
    out = stats.stat_tests_all(SI.board_metrics(spark, sf_dir), BOARD_TESTED, "Library_Name")
    return rounded(out, {"f_value": 8, "kruskal_h": 6})


@query("stat_tests_pvalues")
def stat_tests_pvalues(spark, sf_dir):
    """The test loop with p-values (F tail and chi-square tail, pandas UDF on the result rows)."""
    return stats.stat_tests_all(SI.board_metrics(spark, sf_dir), BOARD_TESTED, "Library_Name", with_p=True)


@query("anova_two_way_pvalues")
def anova_two_way_pvalues(spark, sf_dir):
    out = stats.anova_two_way(spark, SI.laptop_metrics(spark, sf_dir), "M2_Total_Energy_J", "Library_Name", "Platform")
    df_e = out.where(F.col("term") == "Residuals").first()["df"]
    return stats.with_f_pvalue(out.withColumn("df_e", F.lit(df_e)), "f_value", "df", "df_e")


LAPTOP_TESTED = ["M2_Total_Energy_J", "M3_Execution_Time_s", "M4_Model_Accuracy", "M5_Energy_Efficiency"]


def _anova_two_way_sql(value: str) -> str:
    """Type-I sums of squares of library, platform and their interaction (subquery text;
    the library has two levels, so its effect given the platform has a closed form)."""
    return f"""(
  WITH c AS (SELECT Library_Name AS a, Platform AS b, count(*) AS n, avg({value}) AS m, coalesce(var_samp({value}), 0) AS v
             FROM lm WHERE {value} IS NOT NULL AND Library_Name IS NOT NULL AND Platform IS NOT NULL GROUP BY ALL),
  g AS (SELECT sum(n * m) / sum(n) AS grand, sum(n) AS nn, count(*) AS cells, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb,
               sum((n - 1) * v) AS ss_e FROM c),
  sa AS (SELECT sum(na * (ma - grand) * (ma - grand)) AS ss FROM (SELECT sum(n) AS na, sum(n * m) / sum(n) AS ma FROM c GROUP BY a), g),
  sb AS (SELECT sum(nb * (mb - grand) * (mb - grand)) AS ss FROM (SELECT sum(n) AS nb, sum(n * m) / sum(n) AS mb FROM c GROUP BY b), g),
  ab AS (SELECT sum(w * d) * sum(w * d) / sum(w) AS ss FROM (SELECT f.n * o.n / (f.n + o.n) AS w, f.m - o.m AS d
         FROM c f JOIN c o ON f.b = o.b AND f.a = 'F' AND o.a = 'O')),
  t AS (SELECT 'Library_Name' AS term, ka - 1 AS df, sa.ss AS ss FROM sa, g
        UNION ALL SELECT 'Platform', kb - 1, sb.ss + ab.ss - sa.ss FROM sa, sb, ab, g
        UNION ALL SELECT 'Library_Name:Platform', cells - ka - kb + 1,
                  (SELECT sum(n * (m - grand) * (m - grand)) FROM c, g) - sb.ss - ab.ss FROM sb, ab, g
        UNION ALL SELECT 'Residuals', nn - cells, ss_e FROM g)
  SELECT term, CAST(df AS BIGINT) AS df, ss, ss / df AS ms,
         CASE WHEN term <> 'Residuals' THEN (ss / df) / (SELECT ss / df FROM t WHERE term = 'Residuals') END AS f_value FROM t)"""


@query("anova_two_way_all", oracle=Q.with_(Q.LAPTOP) + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, term, df, round(ss, 3) AS ss, round(ms, 3) AS ms, round(f_value, 5) AS f_value FROM {_anova_two_way_sql(m)}"
    for m in LAPTOP_TESTED))
def anova_two_way_all(spark, sf_dir):
    """Two-way ANOVA of every laptop metric."""
    lm = SI.laptop_metrics(spark, sf_dir)
    out = None
    for m in LAPTOP_TESTED:
        one = stats.anova_two_way(spark, lm, m, "Library_Name", "Platform").select(F.lit(m).alias("metric"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out, {"ss": 3, "ms": 3, "f_value": 5})


@query("kruskal_interaction_all", oracle=Q.with_(Q.LAPTOP) + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, n, kruskal_df, round(kruskal_h, 6) AS kruskal_h FROM " + _kruskal_sql('lm', m, "Library_Name || '.' || Platform")
    for m in LAPTOP_TESTED))
def kruskal_interaction_all(spark, sf_dir):
    """Kruskal-Wallis of every laptop metric over library and platform, in one pass."""
    long = (SI.laptop_metrics(spark, sf_dir).select("Library_Name", "Platform", *LAPTOP_TESTED)
            .unpivot(["Library_Name", "Platform"], LAPTOP_TESTED, "metric", "value"))
    out = stats.kruskal(long, "value", ["Library_Name", "Platform"], by=["metric"])
    return rounded(out.select("metric", "n", "kruskal_df", "kruskal_h"), {"kruskal_h": 6})
