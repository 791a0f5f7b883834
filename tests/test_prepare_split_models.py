import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.functions import scalars as S
from wattframe.operators import clean, evaluate, models, runs, split
from wattframe.operators.features import standard_scale_fit


def test_labels_and_dummies(spark):
    df = spark.createDataFrame([("x",), ("M",), ("b",), (None,)], "d string")
    out = df.select(S.label_map_strict("d").alias("s"), S.label_indicator("d").alias("i")).collect()
    assert [r["s"] for r in out] == [None, 1, None, None]
    assert [r["i"] for r in out] == [0, 1, 0, 0]
    cats = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, c string")
    d = clean.one_hot_drop_first(cats, "c")
    assert d.columns == ["id", "c_B", "c_C"]
    assert clean.one_hot_drop_first(cats, "missing").columns == ["id", "c"]


def test_detect_label_column(spark):
    df = spark.createDataFrame([(1, "q", "M"), (2, "r", "b")], "id long, a string, diagnosis string")
    assert clean.detect_label_column_name(df) == "diagnosis"
    with pytest.raises(ValueError):
        clean.detect_label_column_name(df.drop("diagnosis"))


def test_sentinel_and_ratios(spark):
    df = spark.createDataFrame([(-999999.0, 0.0, 5.0), (10.0, 2.0, 5.0)], "e double, d double, a double")
    c = clean.sentinel_to_null(df).collect()
    assert c[0]["e"] is None and c[1]["e"] == 10.0
    r = df.select(S.guarded_ratio("a", "d").alias("g"), S.plain_ratio("a", "d").alias("p")).collect()
    assert r[0]["g"] is None and r[0]["p"] is None and r[1]["g"] == 2.5


def test_exact_split_properties(spark):
    df = spark.range(0, 2003).withColumnRenamed("id", "k").withColumn("cls", (F.col("k") % 3).cast("int"))
    s = split.exact_split(df, ["k"], 0.2)
    assert s.count() == 2003
    assert s.where("is_test").count() == math.ceil(0.2 * 2003)
    # same rows regardless of partitioning
    a = {r["k"] for r in s.where("is_test").collect()}
    b = {r["k"] for r in split.exact_split(df.repartition(5), ["k"], 0.2).where("is_test").collect()}
    assert a == b
    st = split.stratified_split(df, ["k"], "cls", 0.2)
    counts = {r["cls"]: r["count"] for r in st.where("is_test").groupBy("cls").count().collect()}
    sizes = {r["cls"]: r["count"] for r in df.groupBy("cls").count().collect()}
    assert counts == {c: math.ceil(0.2 * n) for c, n in sizes.items()}


def test_batches_exact_sizes(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "k")
    b = split.shuffled_batches(df, ["k"], 16, 2)
    sizes = sorted(r["count"] for r in b.where("epoch = 0").groupBy("batch").count().collect())
    assert sizes == [4] + [16] * 6
    assert b.groupBy("epoch").count().count() == 2


def test_scaling_population_sd(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(10)], "x double, c double")
    sc = standard_scale_fit(df, ["x", "c"])
    out = sc.transform(df).toPandas()
    assert out["x"].mean() == pytest.approx(0.0, abs=1e-12)
    assert out["x"].std(ddof=0) == pytest.approx(1.0)
    assert (out["c"] == 0.0).all()  # constant column: divided by 1


def test_ols_and_gd(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=400), rng.normal(size=400)
    y = 3.0 + 2.0 * x1 - 1.0 * x2 + rng.normal(scale=0.1, size=400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)], "x1 double, x2 double, y double")
    m = models.linreg_ols(df, ["x1", "x2"], "y")
    beta = np.linalg.lstsq(np.column_stack([np.ones(400), x1, x2]), y, rcond=None)[0]
    assert [m.intercept, m.coefficients["x1"], m.coefficients["x2"]] == pytest.approx(list(beta), rel=1e-9)
    gd = models.linreg_gd(df, ["x1", "x2"], "y", lr=0.001, epochs=100, batch_size=32)
    # the same full-batch steps done one by one
    x = np.column_stack([np.ones(400), x1, x2])
    w = np.zeros(3)
    for _ in range(100 * math.ceil(400 / 32)):
        w = w - 0.001 * (2.0 / 400) * (x.T @ (x @ w - y))
    assert [gd.intercept, gd.coefficients["x1"], gd.coefficients["x2"]] == pytest.approx(list(w), rel=1e-9)


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y int, p int")
    r = evaluate.classification_metrics(df, "y", "p").first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0
    assert r["accuracy"] == pytest.approx(1 / 3)
    reg = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, p double")
    m = evaluate.regression_metrics(reg, "y", "p").first()
    assert m["MSE"] == pytest.approx(1 / 6) and m["MAE"] == pytest.approx(1 / 3)
    assert m["r2_score"] == pytest.approx(1 - 0.5 / 2.0)


def test_design_and_latest(spark):
    src = spark.createDataFrame([("TF", "lin"), ("PT", "log"), ("SK", "lin")], "lib string, model string")
    d = runs.design_matrix(src, ["lib", "model"], 15)
    assert d.count() == 3 * 2 * 15
    assert d.where("combo = 0 AND rep = 0").first()["run_id"] == "run_0_repetition_0"
    assert d.where("lib = 'TF' AND model = 'log'").first()["combo"] == 5
    ex = runs.design_exclude(d, spark.createDataFrame([("TF", "log")], "lib string, model string"), ["lib", "model"])
    assert ex.count() == 75
    sh = runs.shuffle_design(d)
    assert sorted(r["position"] for r in sh.collect()) == list(range(90))
    log = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.7), ("n", 1, 0.1)], "model string, t int, acc double")
    latest = {r["model"]: r["acc"] for r in runs.latest_per_key(log, ["model"], ["t"], ["acc"]).collect()}
    assert latest == {"m": 0.7, "n": 0.1}


def _newton_l2_logistic(x, y, c=1.0, iters=50):
    """Minimise C * sum(log-loss) + 0.5 * ||w||^2 (intercept not penalised) by Newton steps."""
    xa = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(xa.shape[1])
    pen = np.eye(xa.shape[1])
    pen[0, 0] = 0.0
    for _ in range(iters):
        p = 1.0 / (1.0 + np.exp(-(xa @ beta)))
        grad = c * xa.T @ (p - y) + pen @ beta
        hess = c * (xa.T * (p * (1 - p))) @ xa + pen
        beta = beta - np.linalg.solve(hess, grad)
    return beta


def test_logreg_l2_matches_c_parametrised_objective(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x @ np.array([1.5, -2.0, 0.5]) + 0.3 + rng.normal(scale=1.0, size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(t)) for (a, b, c), t in zip(x, y)],
                               "a double, b double, c double, y int")
    m = models.logreg_l2(df, ["a", "b", "c"], "y", C=1.0)
    expect = _newton_l2_logistic(x, y, 1.0)
    assert m.intercept == pytest.approx(expect[0], abs=1e-4)
    assert list(m.coefficients.toArray()) == pytest.approx(list(expect[1:]), abs=1e-4)


def test_mlp_and_plain_logreg_learn_a_separable_rule(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "k long, a double, b double, c double, d double, y int")
    feats = ["a", "b", "c", "d"]
    for fit, inclusive in ((lambda t: models.mlp_classify(t, feats, "y", max_iter=100, seed=42), True),
                           (lambda t: models.logreg_plain(t, feats, "y"), False)):
        model = fit(df)
        acc = evaluate.accuracy_only(models.batch_score(model, df, feats, 0.5, inclusive), "y").first()["accuracy"]
        assert acc > 0.95


def test_least_squares_on_columns_of_very_different_size(spark):
    rng = np.random.default_rng(6)
    dur, disc = rng.uniform(1e9, 5e9, 500), rng.uniform(0, 1e-3, 500)
    y = 3.0 + 2e-9 * dur + 5.0 * disc
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(dur, disc, y)], "dur double, disc double, y double")
    own, lib = (models.linreg_ols(df, ["dur", "disc"], "y", method=m) for m in ("normal", "mllib"))
    assert own.coefficients["dur"] == pytest.approx(2e-9, rel=1e-9) and own.coefficients["disc"] == pytest.approx(5.0, rel=1e-6)
    assert own.intercept == pytest.approx(3.0, rel=1e-7) and lib.intercept == pytest.approx(3.0, rel=1e-4)


def test_exact_split_has_no_limit_on_strata(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 700).alias("s")).withColumn("s", F.when(F.col("s") > 0, F.col("s")))
    from wattframe.operators import split
    out = split.exact_split(df, ["id"], 0.4, strata=["s"])
    counts = out.groupBy("s").agg(F.sum(F.col("is_test").cast("int")).alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert len(counts) == 700 and all(r.t == math.ceil(0.4 * r.n) for r in counts)


def test_strict_lookup(spark):
    runs_df = spark.createDataFrame([(1, "A"), (2, "Z")], "run long, key string")
    lookup = spark.createDataFrame([("A", "a.py")], "key2 string, path string")
    out = {r["run"]: r["path"] for r in runs.lookup_by_key(runs_df, lookup, "key", "key2").collect()}
    assert out == {1: "a.py", 2: None}
    with pytest.raises(KeyError):
        runs.lookup_by_key(runs_df, lookup, "key", "key2", strict=True)
