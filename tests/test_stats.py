import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattframe.functions.pvalues import chi2_sf, f_sf
from wattframe.operators import ranking, stats, summary
from wattframe.operators.ranking import exact_quantiles, value_counts_ranked


def test_pvalue_textbook_points():
    assert f_sf(4.0130, 1, 56) == pytest.approx(0.05, abs=2e-4)
    assert f_sf(4.1028, 2, 10) == pytest.approx(0.05, abs=2e-4)
    assert chi2_sf(7.8147, 3) == pytest.approx(0.05, abs=2e-5)
    assert chi2_sf(2 * math.log(20), 2) == pytest.approx(0.05, rel=1e-9)  # closed form exp(-x/2)


def test_pvalue_golden_values():
    # F and H values with the p-values the study's analysis reports (FIXTURES.md section 4)
    assert f_sf(375.3506, 1, 56) == pytest.approx(1.69e-26, rel=0.01)
    assert f_sf(0.0310, 1, 56) == pytest.approx(0.861, abs=1e-3)
    assert f_sf(0.7743, 1, 56) == pytest.approx(0.383, abs=1e-3)
    assert chi2_sf(55.3279, 3) == pytest.approx(5.84e-12, rel=0.01)
    assert chi2_sf(1.1580, 3) == pytest.approx(0.763, abs=1e-3)


def _fixture(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = ["A", "B", "C"][i % 3]
        p = ["X", "Y"][(i // 3) % 2]
        v = float(rnd.randint(0, 40)) + (2.0 if g == "B" else 0.0)  # many ties
        rows.append((i, g, p, v))
    return rows, spark.createDataFrame(rows, "id long, g string, p string, v double")


def _brute_kruskal(pdf, value, groups):
    r = pdf[value].rank(method="average")
    n = len(pdf)
    key = pdf[groups].astype(str).agg(".".join, axis=1)
    h = 12.0 / (n * (n + 1)) * sum(r[key == k].sum() ** 2 / (key == k).sum() for k in key.unique()) - 3 * (n + 1)
    t = pdf[value].value_counts()
    return h / (1 - ((t ** 3 - t).sum()) / (n ** 3 - n)), key.nunique() - 1


def test_kruskal_matches_brute_force(spark):
    rows, df = _fixture(spark)
    pdf = pd.DataFrame(rows, columns=["id", "g", "p", "v"])
    for groups in (["g"], ["g", "p"]):
        h, k = _brute_kruskal(pdf, "v", groups)
        r = stats.kruskal(df, "v", groups).first()
        assert r["kruskal_h"] == pytest.approx(h, rel=1e-10)
        assert r["kruskal_df"] == k


def test_midranks_match_pandas(spark):
    rows, df = _fixture(spark)
    pdf = pd.DataFrame(rows, columns=["id", "g", "p", "v"])
    ranks = pdf["v"].rank(method="average")
    expect = dict(zip(pdf["v"], ranks))
    got = {r["v"]: r["mid_rank"] for r in value_counts_ranked(df, "v", n_buckets=5).collect()}
    assert got == pytest.approx(expect)


def test_exact_quantiles_match_numpy(spark):
    rows, df = _fixture(spark)
    pdf = pd.DataFrame(rows, columns=["id", "g", "p", "v"])
    q = {r["g"]: r for r in exact_quantiles(df, "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}, ["g"], n_buckets=4).collect()}
    for g, part in pdf.groupby("g"):
        assert q[g]["q1"] == pytest.approx(np.quantile(part["v"], 0.25))
        assert q[g]["med"] == pytest.approx(np.quantile(part["v"], 0.5))
        assert q[g]["q3"] == pytest.approx(np.quantile(part["v"], 0.75))


def test_anova_one_way_brute_force(spark):
    rows, df = _fixture(spark)
    pdf = pd.DataFrame(rows, columns=["id", "g", "p", "v"])
    grand = pdf["v"].mean()
    ssb = sum(len(x) * (x["v"].mean() - grand) ** 2 for _, x in pdf.groupby("g"))
    ssw = sum(((x["v"] - x["v"].mean()) ** 2).sum() for _, x in pdf.groupby("g"))
    r = stats.anova_one_way(df, "v", "g").first()
    assert r["ss_between"] == pytest.approx(ssb, rel=1e-9)
    assert r["ss_within"] == pytest.approx(ssw, rel=1e-9)
    assert r["f_value"] == pytest.approx((ssb / 2) / (ssw / (len(pdf) - 3)), rel=1e-9)


def test_anova_two_way_type_one(spark):
    # unbalanced 2 x 3 design; compare with sequential least squares fits
    rnd = random.Random(7)
    rows = []
    for i in range(240):
        a = ["F", "O"][i % 2]
        b = ["A", "N", "R"][(i * 7 // 5) % 3]
        if a == "F" and b == "A" and i % 4 == 0:
            continue
        rows.append((a, b, rnd.gauss(10 + (a == "O") * 1.5 + (b == "N") * 0.7 + (a == "O" and b == "R") * 2, 1.0)))
    df = spark.createDataFrame(rows, "a string, b string, y double")
    pdf = pd.DataFrame(rows, columns=["a", "b", "y"])

    def rss(cols):
        x = np.column_stack([np.ones(len(pdf))] + cols)
        beta = np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)[0]
        return ((pdf["y"].to_numpy() - x @ beta) ** 2).sum()

    da = [(pdf["a"] == "O").astype(float).to_numpy()]
    db = [(pdf["b"] == lv).astype(float).to_numpy() for lv in ("N", "R")]
    dab = [da[0] * d for d in db]
    r0, ra, rab, rfull = rss([]), rss(da), rss(da + db), rss(da + db + dab)
    out = {r["term"]: r for r in stats.anova_two_way(spark, df, "y", "a", "b").collect()}
    assert out["a"]["ss"] == pytest.approx(r0 - ra, rel=1e-8)
    assert out["b"]["ss"] == pytest.approx(ra - rab, rel=1e-8)
    assert out["a:b"]["ss"] == pytest.approx(rab - rfull, rel=1e-8)
    assert out["Residuals"]["ss"] == pytest.approx(rfull, rel=1e-8)
    assert out["a:b"]["df"] == 2 and out["Residuals"]["df"] == len(rows) - 6


def test_stat_tests_gate(spark):
    rows = [("A", 1.0, 5.0), ("A", 2.0, None), ("B", 3.0, None), ("B", 4.0, None), ("C", 5.0, None),
            ("C", 6.0, None), ("C", 7.0, 6.0)]
    df = spark.createDataFrame(rows, "lib string, m1 double, m2 double").withColumn("m3", F.lit(None).cast("double"))
    out = {r["metric"]: r for r in stats.stat_tests_all(df, ["m1", "m2", "m3"], "lib", with_p=True).collect()}
    assert out["m3"]["n_rows"] == 0 and out["m3"]["result"] == stats.INSUFFICIENT
    assert out["m1"]["testable"] and out["m1"]["result"] == "tested" and out["m1"]["anova_p"] is not None
    assert not out["m2"]["testable"] and out["m2"]["result"] == stats.INSUFFICIENT
    assert out["m2"]["f_value"] is None and out["m2"]["n_rows"] == 2


def test_boxplot_and_correlation(spark):
    vals = [10.0, 10.2, 10.4, 10.5, 10.6, 10.9, 12.7]
    df = spark.createDataFrame([("g", v, v * 2 + (i % 2)) for i, v in enumerate(vals)], "k string, v double, w double")
    b = summary.boxplot_stats(df, ["k"], "v").first()
    q1, q3 = np.quantile(vals, 0.25), np.quantile(vals, 0.75)
    hi = q3 + 1.5 * (q3 - q1)
    assert b["Q1"] == pytest.approx(q1) and b["Q3"] == pytest.approx(q3)
    assert b["Upper_Whisker"] == max(v for v in vals if v <= hi)
    assert b["N_Outliers"] == sum(v > hi or v < q1 - 1.5 * (q3 - q1) for v in vals)
    c = summary.correlation_matrix(df, ["v", "w"]).first()
    assert c["r"] == pytest.approx(np.corrcoef(vals, [v * 2 + (i % 2) for i, v in enumerate(vals)])[0, 1])


def test_density_integrates_to_one(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([("g", rnd.gauss(0, 1)) for _ in range(500)], "k string, v double")
    d = summary.density_curve(df, "v", "k").orderBy("grid_index").toPandas()
    step = d["x"].iloc[1] - d["x"].iloc[0]
    assert (d["density"].sum() * step) == pytest.approx(1.0, abs=0.01)


def test_rows_without_a_factor_are_left_out(spark):
    rows = [("A", "x", 1.0), ("A", "x", 2.0), ("B", "y", 5.0), ("B", "x", 7.0), ("A", "y", 3.0), ("B", "y", 6.5), (None, "x", 900.0), ("A", None, 800.0)]
    df = spark.createDataFrame(rows, "a string, b string, v double")
    clean = df.dropna(subset=["a"])
    assert stats.anova_one_way(df, "v", "a").collect() == stats.anova_one_way(clean, "v", "a").collect()
    assert stats.kruskal(df, "v", ["a"]).collect() == stats.kruskal(clean, "v", ["a"]).collect()
    both = df.dropna()
    assert stats.anova_two_way(spark, df, "v", "a", "b").collect() == stats.anova_two_way(spark, both, "v", "a", "b").collect()
    gate = {r["metric"]: r for r in summary.test_gate(df, "a", ["v"]).collect()}["v"]
    loop = {r["metric"]: r for r in stats.stat_tests_all(df, ["v"], "a").collect()}["v"]
    assert (gate["n_rows"], gate["n_groups"], gate["testable"]) == (loop["n_rows"], loop["n_groups"], loop["testable"]) == (7, 2, True)


def test_two_way_anova_with_many_levels(spark):
    rnd = random.Random(3)
    rows = [(i % 1500, "p%d" % (i % 2 if i % 7 else 0), rnd.gauss(i % 1500 % 5, 1)) for i in range(6000)]
    df = spark.createDataFrame(rows, "a int, b string, y double")
    one = {r["term"]: r for r in stats.anova_two_way(spark, df, "y", "a", "b").collect()}
    two = {r["term"]: r for r in stats.anova_two_way(spark, df, "y", "b", "a").collect()}
    assert one["a"]["ss"] + one["b"]["ss"] == pytest.approx(two["a"]["ss"] + two["b"]["ss"], rel=1e-9)
    assert one["a:b"]["ss"] == pytest.approx(two["b:a"]["ss"], rel=1e-6) and one["a"]["df"] == 1499


def test_tails_for_large_degrees_of_freedom():
    from wattframe.functions.pvalues import chi2_sf, f_sf

    # golden values: limits of the distributions (chi-square(3) > 9, normal tails) and exact points
    assert chi2_sf(9.0, 3) == pytest.approx(0.0292908865, rel=1e-8)
    assert f_sf(3.0, 2, 6e11) == pytest.approx(math.exp(-3.0), rel=1e-9)
    assert f_sf(3.0, 2, 30) == pytest.approx((1 + 2 * 3.0 / 30) ** -15, rel=1e-10)
    assert chi2_sf(1e9, 1e9) == pytest.approx(0.5, abs=1e-4)
    k = 4e6
    assert chi2_sf(k + 2 * math.sqrt(2 * k), k) == pytest.approx(0.02275, rel=5e-3)


def test_density_equals_the_exact_kernel_sum(spark):
    rnd = random.Random(2)
    vals = [rnd.gauss(0, 1) + (rnd.random() < 0.3) * 5 for _ in range(400)]
    df = spark.createDataFrame([("g", v) for v in vals], "k string, v double")
    d = summary.density_curve(df, "v", "k").toPandas()
    x, h = d["x"].to_numpy(), d["bandwidth"].iloc[0]
    exact = np.exp(-0.5 * ((x[:, None] - np.array(vals)[None, :]) / h) ** 2).sum(axis=1) / (len(vals) * h * math.sqrt(2 * math.pi))
    assert np.abs(d["density"].to_numpy() - exact).max() < 1e-3 * exact.max()


def test_values_are_counted_and_ranked_by_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TASK_ROWS", 100)
    df = spark.range(2000, numPartitions=1).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.lit(7)).cast("double").alias("v"))
    out = value_counts_ranked(df, "v", carry_cols=["g"])
    per_task = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(per_task) > 10 and max(per_task) < 200
    got = {(r["g"], r["v"]): (r["n_c"], r["n_ties"], r["mid_rank"]) for r in out.collect()}
    assert len(got) == 1003 and got[0, 7.0][1:] == (1000, 4 + 500.5) and sum(x[0] for x in got.values()) == 2000
    assert got[0, 0.0] == (1, 1, 1.0) and got[0, 1998.0] == (1, 1, 2000.0)
