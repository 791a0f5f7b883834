"""Selected quantiles, box data, densities; least squares by QR; two-way ANOVA on tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import models, selection, stats, summary, tsqr


def groups_of(rows):
    out = {}
    for *key, v in rows:
        out.setdefault(tuple(key), []).append(v)
    return out


def check_quantiles(spark, rows, accuracy):
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["g"]: r for r in selection.quantiles(df, "v", probs, ["g"], accuracy).collect()}
    want = groups_of(rows)
    assert set(got) == {k[0] for k in want}
    for (g,), vs in want.items():
        vs = [v for v in vs if v is not None]
        for name, p in probs.items():
            if vs:
                assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-13, abs=1e-300), (g, name)
            else:
                assert got[g][name] is None


@pytest.mark.parametrize("accuracy", [50, 2000])
def test_exact_whatever_the_values(spark, accuracy):
    rng = random.Random(9)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(6000)]
    rows += [("zeros", 0.0 if rng.random() < 0.99 else rng.random()) for _ in range(3000)]
    rows += [("few", float(rng.randrange(3))) for _ in range(2000)] + [(None, float(i)) for i in range(777)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None), ("none", None), ("some", None), ("some", -1.0)]
    rng.shuffle(rows)
    check_quantiles(spark, rows, accuracy)


def test_many_groups_and_many_between_take_the_other_way(spark, monkeypatch):
    rows = [(f"g{i % 7}", float(i * 37 % 101)) for i in range(500)] + [("null", None)]
    for name in ("MOST_GROUPS", "MOST_BETWEEN"):
        with monkeypatch.context() as m:
            m.setattr(selection, name, 3)
            check_quantiles(spark, rows, 50)


def test_only_what_lies_between_is_counted(spark, monkeypatch):
    seen = []
    real = selection.frozen_small
    monkeypatch.setattr(selection, "frozen_small", lambda df: (lambda r: (seen.append(r[1]), r)[1])(real(df)))
    df = spark.range(200_000).select(F.rand(3).alias("v"))
    out = selection.quantiles(df, "v", {"m": 0.5}, accuracy=1000).first()["m"]
    assert out == pytest.approx(float(np.median([r[0] for r in df.collect()])))
    assert seen[1] < 200_000 * 5 / 1000          # of 200 000 distinct values


def test_box_data_keep_null_groups(spark):
    rows = [("a", float(i)) for i in range(20)] + [("a", 500.0), ("a", None), ("b", None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in summary.boxplot_stats(df, ["g"], "v").collect()}
    assert set(got) == {"a", "b", None}
    assert (got["a"]["N"], got["a"]["N_Outliers"], got["a"]["Upper_Whisker"]) == (21, 1, 19.0)
    assert (got["b"]["N"], got["b"]["N_Outliers"], got["b"]["Median"], got["b"]["Upper_Whisker"]) == (0, 0, None, None)
    assert (got[None]["N"], got[None]["Median"], got[None]["Lower_Whisker"]) == (2, 3.5, 3.0)
    assert [r["v"] for r in summary.boxplot_outliers(df, ["g"], "v").collect()] == [500.0]


def exact_density(vs, x, bw):
    vs, x = np.array(vs), np.array(x)
    return np.exp(-0.5 * ((x[:, None] - vs[None, :]) / bw) ** 2).sum(axis=1) / (len(vs) * bw * math.sqrt(2 * math.pi))


def test_densities_are_the_sums_over_all_points(spark):
    rng = random.Random(1)
    rows = [("normal", rng.gauss(5, 2)) for _ in range(900)] + [("heavy", rng.lognormvariate(0, 4)) for _ in range(500)]
    rows += [("equal", 2.0)] * 40 + [("one", 7.0)] + [(None, float(i % 5)) for i in range(60)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for panel in (None, []):
        curves = {}
        for r in summary.density_curve(df, "v", "g", panel=panel).collect():
            curves.setdefault(r["g"], []).append((r["grid_index"], r["x"], r["density"], r["bandwidth"]))
        assert set(curves) == {"normal", "heavy", "equal", "one", None}
        for g, points in curves.items():
            points.sort()
            assert [p[0] for p in points] == list(range(512))
            vs, x, bw = [v for k, v in rows if k == g and v is not None], [p[1] for p in points], points[0][3]
            peak = 1 / (bw * math.sqrt(2 * math.pi))
            assert np.abs(np.array([p[2] for p in points]) - exact_density(vs, x, bw)).max() < 1e-13 * peak
        if panel is not None:
            assert len({(p[0][1], p[-1][1]) for p in curves.values()}) == 1


def test_one_grid_per_panel(spark):
    df = spark.createDataFrame([("m1", "a", 1.0), ("m1", "a", 2.0), ("m1", "b", 9.0), ("m2", "a", 100.0), ("m2", "a", 300.0)], "m string, g string, v double")
    ends = {}
    for r in summary.density_curve(df, "v", ["m", "g"], panel=["m"]).collect():
        ends.setdefault((r["m"], r["g"]), []).append(r["x"])
    assert {k: (min(v), max(v)) for k, v in ends.items()} == {("m1", "a"): (1.0, 9.0), ("m1", "b"): (1.0, 9.0), ("m2", "a"): (100.0, 300.0)}


# ---- least squares by QR

def test_vandermonde_design(spark):
    n, d = 4000, 8
    x = np.linspace(0, 1, n) * 12
    design = np.vander(x, d, increasing=True)
    assert 1e8 < np.linalg.cond(design) < 1e11
    beta = np.array([3.0, -2.0, 1.0, 0.5, -0.25, 2.0, -1.5, 0.75])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(40)
    df = df.select(*[F.expr("*".join(["x"] * k) if k else "1d").alias(f"c{k}") for k in range(d)])
    y = F.lit(0.0)
    for k in range(d):
        y = y + F.lit(float(beta[k])) * F.col(f"c{k}")
    fit = tsqr.least_squares(df.withColumn("y", y), [f"c{k}" for k in range(d)], "y")
    assert fit.rank == d and fit.n_rows == n
    assert np.abs(fit.beta / beta - 1).max() < 1e-9


def test_residuals_rank_and_missing_values(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=500), rng.normal(size=500)
    y = 2 + 3 * a - b + rng.normal(size=500)
    rows = [(float(p), float(q), float(p + q), float(z)) for p, q, z in zip(a, b, y)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, both double, y double")
    m = models.linreg_ols(df, ["a", "b"], "y", method="qr")
    want = np.linalg.lstsq(np.column_stack([np.ones(500), a, b]), y, rcond=None)[0]
    assert [m.intercept, m.coefficients["a"], m.coefficients["b"]] == pytest.approx(want, rel=1e-12)
    assert m.rank == 3
    low = models.linreg_ols(df, ["a", "b", "both"], "y", method="qr")
    assert low.rank == 3
    pred = low.intercept + low.coefficients["a"] * a + low.coefficients["b"] * b + low.coefficients["both"] * (a + b)
    assert np.abs(pred - np.column_stack([np.ones(500), a, b]) @ want).max() < 1e-10
    with pytest.raises(ValueError, match="rank 2 of 3"):
        tsqr.least_squares(df, ["a", "b", "both"], "y", strict=True)
    with pytest.raises(ValueError, match="no rows"):
        tsqr.least_squares(df.where("a > 1e9"), ["a"], "y")


def test_the_tree_of_triangles(spark):
    df = spark.range(2000).select(F.col("id").cast("double").alias("x"), F.sin("id").alias("z"), F.cos("id").alias("y")).repartition(50)
    r, n = tsqr.r_factor(df, ["x", "z", "y"], fanout=3)
    x = np.array([tuple(row) for row in df.collect()])
    assert n == 2000 and np.abs(r).T @ np.ones(3) == pytest.approx(np.abs(np.linalg.qr(x, mode="r")).T @ np.ones(3), rel=1e-9)
    assert r.T @ r == pytest.approx(x.T @ x, rel=1e-9)


# ---- two-way ANOVA

def test_iterative_and_dense_effects_agree(spark):
    rng = random.Random(6)
    rows = [(f"a{rng.randrange(40)}", f"b{rng.randrange(30)}", rng.gauss(0, 1) + i % 3) for i in range(900)]
    rows += [("lone a", "lone b", 4.0), ("lone a", "lone b", 5.0)]      # a part of the design that hangs together with nothing
    df = spark.createDataFrame(rows, "a string, b string, v double")
    dense = stats.anova_two_way(spark, df, "v", "a", "b").collect()
    tables = stats.anova_two_way(spark, df, "v", "a", "b", dense_levels=0).collect()
    for x, y in zip(dense, tables):
        assert (x["term"], x["df"]) == (y["term"], y["df"])
        assert y["ss"] == pytest.approx(x["ss"], rel=1e-9)


def test_thousands_of_levels_on_both_sides(spark):
    n = 3000
    rows = spark.range(4 * n).select((F.col("id") % n).alias("a"), (F.hash(F.col("id")) % n).alias("b"), F.sin(F.col("id") * 1.7).alias("v"))
    pdf = rows.toPandas()
    a, b, y = pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["v"].to_numpy()
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    got = {r["term"]: r["ss"] for r in stats.anova_two_way(spark, rows, "v", "a", "b").collect()}
    # dense solve of the additive model, effects of a eliminated
    na, nb = np.bincount(a), np.bincount(b)
    yc = y - y.mean()
    cells = np.zeros((len(na), len(nb)))
    np.add.at(cells, (a, b), 1.0)
    sa, sb = np.bincount(a, yc), np.bincount(b, yc)
    lhs = np.diag(nb.astype(float)) - cells.T @ (cells / na[:, None])
    rhs = sb - cells.T @ (sa / na)
    want = float(rhs @ np.linalg.lstsq(lhs, rhs, rcond=1e-11)[0]) if len(nb) < 2000 else float(rhs @ np.linalg.solve(lhs + np.ones_like(lhs) / len(nb), rhs))
    assert got["a"] == pytest.approx((sa**2 / na).sum(), rel=1e-9)
    assert got["b"] == pytest.approx(want, rel=1e-8)
