
from __future__ import annotations

import datetime as _dt

from pyspark import StorageLevel
from pyspark.sql import functions as F

from wattframe.functions import scalars as S
from wattframe.operators import clean, evaluate, models, permute, split
from wattframe.operators.features import array_to_columns, standard_scale_fit
from wattframe.plans import sql_tables as Q
from wattframe.plans import standins as SI
from wattframe.plans.catalog import ORACLES, query
from wattframe.plans.common import rounded

_H = "('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT"


@query("train_test_split", oracle=f"""
WITH h AS (SELECT o_orderkey, {_H} AS split_hash FROM orders)
SELECT o_orderkey, split_hash, split_hash < 0.25 * 4294967296.0 AS is_test_bernoulli,
       row_number() OVER (ORDER BY split_hash, o_orderkey) <= ceil(0.25 * count(*) OVER ()) AS is_test
FROM h""")
def train_test_split(spark, sf_dir):
    o = SI.table(spark, sf_dir, "orders").select("o_orderkey")
    b = split.bernoulli_split(o, ["o_orderkey"], 0.25, out="is_test_bernoulli")
    return split.exact_split(b, ["o_orderkey"], 0.25).select("o_orderkey", "split_hash", "is_test_bernoulli", "is_test")


@query("stratified_split", oracle=f"""
WITH h AS (SELECT o_orderkey, o_orderstatus, {_H} AS split_hash FROM orders)
SELECT o_orderkey, o_orderstatus, split_hash,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY split_hash, o_orderkey)
         <= ceil(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) AS is_test
FROM h""")
def stratified_split(spark, sf_dir):
    o = SI.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(o, ["o_orderkey"], "o_orderstatus", 0.2)


_EPOCHS, _BATCH = 2, 16
_EPOCH_KEYS = "[" + ", ".join(str([*permute.round_keys(42, e)]) for e in range(_EPOCHS)) + "][CAST(epoch AS INTEGER) + 1]"


@query("shuffled_batches", oracle=f"""
WITH g AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS b FROM orders),
h AS (SELECT n, b, (n + b - 1) // b AS a FROM g),
p AS (SELECT o_orderkey, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT, o_orderkey) - 1 AS position FROM orders),
e AS (SELECT o_orderkey, position, CAST(r.epoch AS INTEGER) AS epoch, n, a, b, least(a * b - n + 1, {permute.WALKS}) AS steps
      FROM p, h CROSS JOIN range(0, {_EPOCHS}) r(epoch))
SELECT o_orderkey, epoch, {permute.permuted_sql("position", "n", "a", "b", "steps", _EPOCH_KEYS)} // {_BATCH} AS batch FROM e""")
def shuffled_batches(spark, sf_dir):
    o = SI.table(spark, sf_dir, "orders").select("o_orderkey")
    return split.shuffled_batches(o, ["o_orderkey"], _BATCH, _EPOCHS)


@query("standard_scale", oracle=f"""
WITH h AS (SELECT o_orderkey, o_totalprice, o_custkey, {_H} < 0.2 * 4294967296.0 AS is_test FROM orders),
st AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(o_custkey) AS m2,
              stddev_pop(o_custkey) AS s2 FROM h WHERE NOT is_test)
SELECT o_orderkey, is_test,
       round((o_totalprice - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 9) AS o_totalprice_scaled,
       round((o_custkey - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 9) AS o_custkey_scaled
FROM h, st""")
def standard_scale(spark, sf_dir):
    o = SI.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    d = split.bernoulli_split(o, ["o_orderkey"], 0.2)
    sc = standard_scale_fit(d.where(~F.col("is_test")), ["o_totalprice", "o_custkey"])
    out = sc.transform(d, suffix="_scaled").select("o_orderkey", "is_test", "o_totalprice_scaled", "o_custkey_scaled")
    return rounded(out, {"o_totalprice_scaled": 9, "o_custkey_scaled": 9})


_GRAM_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size"]
# y = price / 1024: a power of two keeps the scaling exact in binary and the
# exact sums off decimal rounding ties (price / 1000 x integer has exactly five
# decimals, so rounding to four would land on ties).


def _gram_sql():
    terms = ["1", *_GRAM_FEATURES, "y"]
    expr = {"1": "1.0", "y": "(l_extendedprice / 1024.0)"}
    parts = []
    for i, a in enumerate(terms):
        for b in terms[i:]:
            ea, eb = expr.get(a, f"CAST({a} AS DOUBLE)"), expr.get(b, f"CAST({b} AS DOUBLE)")
            parts.append(f"SELECT '{a}' AS term_i, '{b}' AS term_j, round(sum({ea} * {eb}), 4) AS value FROM reg")
    return Q.with_(Q.REGRESSION) + " UNION ALL ".join(parts)


@query("gram_matrix", oracle=_gram_sql())
def gram_matrix(spark, sf_dir):
    r = SI.regression_table(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / F.lit(1024.0))
    return rounded(models.gram_matrix(r, _GRAM_FEATURES, "y"), {"value": 4})


@query("linreg_ols", oracle="""
SELECT round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_slope(l_extendedprice, l_quantity), 6) AS l_quantity FROM lineitem""")
def linreg_ols(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    m = models.linreg_ols(li, ["l_quantity"], "l_extendedprice", method="qr")
    return spark.createDataFrame([(round(m.intercept, 6), round(m.coefficients["l_quantity"], 6))],
                                 "intercept double, l_quantity double")


@query("batch_score", oracle="""
WITH f AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS b0, regr_slope(l_extendedprice, l_quantity) AS b1
           FROM lineitem)
SELECT l_orderkey, l_linenumber, round(b0 + b1 * l_quantity, 4) AS prediction FROM lineitem, f""")
def batch_score(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    m = models.linreg_ols(li, ["l_quantity"], "l_extendedprice")
    out = models.batch_score(m, li, ["l_quantity"]).select("l_orderkey", "l_linenumber", "prediction")
    return rounded(out, {"prediction": 4})


@query("regression_metrics", oracle="""
WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1450.0 AS yhat FROM lineitem)
SELECT count(*) AS n, round(sum((y - yhat) * (y - yhat)) / count(*), 4) AS MSE,
       round(sqrt(sum((y - yhat) * (y - yhat)) / count(*)), 6) AS RMSE, round(avg(abs(y - yhat)), 6) AS MAE,
       round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 10) AS r2_score
FROM p""")
def regression_metrics(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    p = li.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.lit(1450.0)).alias("yhat"))
    return rounded(evaluate.regression_metrics(p, "y", "yhat"), {"MSE": 4, "RMSE": 6, "MAE": 6, "r2_score": 10})


_CLS_SQL = """
WITH p AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(o_totalprice > 200000 AS INTEGER) AS yhat
           FROM orders),
c AS (SELECT count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn FROM p)
"""


def _cls_preds(spark, sf_dir):
    o = SI.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"),
                    (F.col("o_totalprice") > 200000).cast("int").alias("yhat"))


@query("classification_metrics", oracle=_CLS_SQL + """
SELECT tp, fp, fn, tn, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 10) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 10) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 10) AS recall,
       round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 10) AS f1
FROM c""")
def classification_metrics(spark, sf_dir):
    out = evaluate.classification_metrics(_cls_preds(spark, sf_dir), "y", "yhat")
    return rounded(out, {c: 10 for c in ("accuracy", "precision", "recall", "f1")})


@query("accuracy_only", oracle="""
WITH p AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(o_totalprice > 200000 AS INTEGER) AS yhat FROM orders)
SELECT round(avg(CAST(y = yhat AS DOUBLE)), 10) AS accuracy FROM p""")
def accuracy_only(spark, sf_dir):
    return rounded(evaluate.accuracy_only(_cls_preds(spark, sf_dir), "y", "yhat"), {"accuracy": 10})


@query("preview_predictions", oracle="""
SELECT o_orderkey, round(1.0 / (1.0 + exp(-((o_totalprice - 200000.0) / 100000.0))), 12) AS probability
FROM orders ORDER BY o_orderkey LIMIT 5""")
def preview_predictions(spark, sf_dir):
    o = SI.table(spark, sf_dir, "orders")
    s = o.select("o_orderkey", S.sigmoid((F.col("o_totalprice") - F.lit(200000.0)) / F.lit(100000.0)).alias("probability"))
    return rounded(evaluate.preview_predictions(s, "o_orderkey", 5), {"probability": 12})


# --- trainer flows (model output is not SQL-expressible: row checks) -----------------
#
# A flow reads its prepared table several times (split cut, scaler, fit, score),
# so the table is persisted for the duration of the flow and released at the
# end; the flow's result is the one-row metrics table, computed eagerly.

def _run_flow(spark, prepared, fn):
    data = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        res = fn(data)
        rows, schema = res.collect(), res.schema
    finally:
        data.unpersist()
    return spark.createDataFrame(rows, schema)


#: (order, line) is not unique; rows equal in all of these are interchangeable
LINE_KEY = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "p_size", "p_retailprice"]


def _regression_prepared(spark, sf_dir, keep=()):
    r = SI.regression_table(spark, sf_dir).drop(*[c for c in ["l_linenumber"] if c not in keep])
    r = clean.drop_null_rows(r)
    # the categories are those of the part table: no join is run to list them
    levels = clean.category_levels(SI.table(spark, sf_dir, "part"), "p_type")
    return clean.one_hot_drop_first(r, "p_type", levels)


def _reg_features(df):
    return [c for c in df.columns if c not in ("l_orderkey", "l_extendedprice", "split_hash", "is_test")]


@query("linreg_ols_fit")
def linreg_ols_fit(spark, sf_dir):
    """Library linear flow: drop NULL rows, 25 % hash split by order, OLS, metrics on the test rows."""
    r = SI.regression_table(spark, sf_dir).drop("p_type", "l_linenumber")
    r = clean.drop_null_rows(r)

    def flow(data):
        # lineitem has no unique row key: hash the order key (an order's lines stay together)
        d = split.bernoulli_split(data, ["l_orderkey"], 0.25)
        feats = _reg_features(d)
        m = models.linreg_ols(d.where(~F.col("is_test")), feats, "l_extendedprice", method="mllib")
        return evaluate.regression_metrics(m.transform(d.where(F.col("is_test"))), "l_extendedprice")

    return _run_flow(spark, r, flow)


def _scaled_split(df, key_cols, feats, fraction, label=None, exact=True):
    """Split (exact / stratified on a unique key, else Bernoulli on the key),
    fit the scaler on the training rows, scale both sides."""
    if not exact:
        d = split.bernoulli_split(df, key_cols, fraction)
    elif label:
        d = split.stratified_split(df, key_cols, label, fraction)
    else:
        d = split.exact_split(df, key_cols, fraction)
    sc = standard_scale_fit(d.where(~F.col("is_test")), feats)
    return sc.transform(d)


@query("linreg_gd")
def linreg_gd(spark, sf_dir):
    """Network-library linear flow: dummies, 20 % split, scaling, gradient descent
    (lr 0.001, 100 epochs, batch 32 step count), metrics on the test rows."""
    r = _regression_prepared(spark, sf_dir)

    def flow(data):
        feats = _reg_features(data)
        d = _scaled_split(data, ["l_orderkey"], feats, 0.2, exact=False)
        m = models.linreg_gd(d.where(~F.col("is_test")), feats, "l_extendedprice", lr=0.001, epochs=100,
                             batch_size=32)
        return evaluate.regression_metrics(m.transform(d.where(F.col("is_test"))), "l_extendedprice")

    return _run_flow(spark, r, flow)


def _embeddings(spark, sf_dir):
    em = SI.embeddings_table(spark, sf_dir)
    return array_to_columns(em, "embedding", 64, "e")


@query("logreg_l2")
def logreg_l2(spark, sf_dir):
    """Library logistic flow: 25 % split, L2 (C = 1) logistic regression, unscaled, test metrics."""
    em, feats = _embeddings(spark, sf_dir)

    def flow(data):
        d = split.exact_split(data, ["vec_id"], 0.25)
        m = models.logreg_l2(d.where(~F.col("is_test")), feats, "label", C=1.0, max_iter=10000)
        pred = models.batch_score(m, d.where(F.col("is_test")), feats, 0.5, inclusive=False)
        return evaluate.classification_metrics(pred, "label")

    return _run_flow(spark, em, flow)


@query("logreg_plain")
def logreg_plain(spark, sf_dir):
    """Network-library logistic flow on the regression table: target above median, 20 %
    split stratified by it, scaling, unpenalised logistic regression, accuracy."""
    return _logreg_plain_flow(spark, sf_dir)


def _logreg_plain_flow(spark, sf_dir, shares=False):
    r = _regression_prepared(spark, sf_dir, keep=["l_linenumber"])
    from wattframe.operators.selection import quantiles
    prices = SI.table(spark, sf_dir, "lineitem").join(SI.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    med = quantiles(prices, "l_extendedprice", {"m": 0.5}).first()["m"]
    r = r.withColumn("label", (F.col("l_extendedprice") > F.lit(med)).cast("int"))

    def flow(data):
        feats = [c for c in _reg_features(data) if c not in ("label", "l_linenumber")]
        d = _scaled_split(data, LINE_KEY, feats, 0.2, label="label")
        if shares:
            return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))
        m = models.logreg_plain(d.where(~F.col("is_test")), feats, "label")
        pred = models.batch_score(m, d.where(F.col("is_test")), feats, 0.5, inclusive=False)
        return evaluate.accuracy_only(pred, "label")

    return _run_flow(spark, r, flow)


@query("logreg_plain_split", oracle=Q.with_(Q.REGRESSION) + """,
m AS (SELECT median(l_extendedprice) AS m FROM reg), c AS (SELECT CAST(l_extendedprice > m AS INTEGER) AS label, count(*) AS n FROM reg, m GROUP BY ALL)
SELECT label, n, CAST(ceil(0.2 * n) AS BIGINT) AS n_test FROM c""")
def logreg_plain_split(spark, sf_dir):
    """The classes of the flow's split: each gives a fifth of its rows, to within one."""
    return _logreg_plain_flow(spark, sf_dir, shares=True)


def _mlp_flow(data, feats):
    d = _scaled_split(data, ["vec_id"], feats, 0.2, label="label")
    m = models.mlp_classify(d.where(~F.col("is_test")), feats, "label", max_iter=100, seed=42)
    pred = models.batch_score(m, d.where(F.col("is_test")), feats, 0.5, inclusive=True)
    return evaluate.classification_metrics(pred, "label")


@query("mlp_classify")
def mlp_classify(spark, sf_dir):
    """Network flow: stratified 20 % split, scaling, d -> 32 -> 16 -> 2 network, threshold >= 0.5, metrics."""
    em, feats = _embeddings(spark, sf_dir)
    return _run_flow(spark, em.drop("embedding"), lambda data: _mlp_flow(data, feats))


@query("mlp_classify_bounds", oracle="""
WITH c AS (SELECT label = 5 AS y, count(*) AS n FROM embeddings GROUP BY ALL),
t AS (SELECT y, CAST(ceil(0.2 * n) AS BIGINT) AS n FROM c)
SELECT CAST(sum(n) AS BIGINT) AS n_test, CAST(sum(n) FILTER (y) AS BIGINT) AS n_positive, true AS accuracy_holds FROM t""")
def mlp_classify_bounds(spark, sf_dir):
    """What must hold of the network's flow whatever its weights: the test rows of each
    class, and an accuracy of at least the larger class's share less 0.1."""
    m = mlp_classify(spark, sf_dir)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    positive = F.col("tp") + F.col("fn")
    return m.select(n.cast("long").alias("n_test"), positive.cast("long").alias("n_positive"),
                    (F.col("accuracy") >= F.greatest(positive, n - positive) / n - F.lit(0.1)).alias("accuracy_holds"))


@query("linreg_gd_steps", oracle="""
WITH h AS (SELECT l_quantity AS q, l_extendedprice AS y,
                  ('0x' || substr(md5('42:' || l_orderkey), 1, 8))::BIGINT < 0.2 * 4294967296.0 AS is_test FROM lineitem),
s AS (SELECT count(*) AS n, avg(q) AS mq, stddev_pop(q) AS sq, avg(y) AS my, covar_pop(q, y) AS c FROM h WHERE NOT is_test),
t AS (SELECT *, pow(1.0 - 2.0 * 0.0002, ceil(n / 32.0)) AS left_over FROM s)
SELECT CAST(ceil(n / 32.0) AS BIGINT) AS steps, round(my * (1 - left_over), 4) AS intercept, round(c / sq * (1 - left_over), 4) AS slope FROM t""")
def linreg_gd_steps(spark, sf_dir):
    """The gradient descent part-way: after one epoch's steps on one standardised
    feature, for which the weights have a closed form."""
    li = split.bernoulli_split(SI.table(spark, sf_dir, "lineitem"), ["l_orderkey"], 0.2).where(~F.col("is_test"))
    train = standard_scale_fit(li, ["l_quantity"]).transform(li)
    m = models.linreg_gd(train, ["l_quantity"], "l_extendedprice", lr=0.0002, epochs=1, batch_size=32)
    n = train.count()
    return spark.createDataFrame([(-(-n // 32), round(m.intercept, 4), round(m.coefficients["l_quantity"], 4))],
                                 "steps long, intercept double, slope double")


@query("linreg_gd_bounds", oracle="""
SELECT count(*) FILTER (WHERE ('0x' || substr(md5('42:' || l_orderkey), 1, 8))::BIGINT < 0.2 * 4294967296.0) AS n_test,
       true AS error_holds FROM lineitem JOIN part ON l_partkey = p_partkey""")
def linreg_gd_bounds(spark, sf_dir):
    """What must hold of the whole flow: its test rows, and a test error between that of
    least squares on the same rows, less 1 %, and 1.5 times that plus the variance left."""
    r = _regression_prepared(spark, sf_dir)

    def flow(data):
        feats = _reg_features(data)
        d = _scaled_split(data, ["l_orderkey"], feats, 0.2, exact=False)
        train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
        gd = models.linreg_gd(train, feats, "l_extendedprice", lr=0.001, epochs=100, batch_size=32)
        best = models.linreg_ols(train, feats, "l_extendedprice")
        a = evaluate.regression_metrics(gd.transform(test), "l_extendedprice").select("n", F.col("MSE").alias("a"))
        b = evaluate.regression_metrics(best.transform(test), "l_extendedprice").select(F.col("MSE").alias("b"))
        both = a.first(), b.first()
        return spark.createDataFrame([(both[0]["n"], 0.99 * both[1]["b"] <= both[0]["a"] <= 1.5 * both[1]["b"])], "n_test long, error_holds boolean")

    return _run_flow(spark, r, flow)


@query("fit_time")
def fit_time(spark, sf_dir):
    """Seconds for an OLS fit plus scoring of the regression table."""
    r = SI.regression_table(spark, sf_dir)
    feats = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]

    def fit_and_score():
        m = models.linreg_ols(r, feats, "l_extendedprice")
        return m.transform(r).agg(F.count("prediction")).first()[0]

    n, secs = models.fit_time(fit_and_score)
    return spark.createDataFrame([(int(n), float(secs))], "n_scored long, fit_seconds double")


@query("stamp_run")
def stamp_run(spark, sf_dir):
    """Metrics row stamped with run time, model name, seed, test size, epochs, batch size."""
    return _stamped(spark, sf_dir, _dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S"))


def _stamped(spark, sf_dir, stamp):
    m = regression_metrics(spark, sf_dir)
    return m.select(F.lit(stamp).alias("timestamp"), F.lit("linear_regression").alias("model"), "*",
                    F.lit(42).alias("random_seed"), F.lit(0.2).alias("test_size"), F.lit(100).alias("epochs"),
                    F.lit(32).alias("batch_size"))


@query("fit_scored_rows", oracle="SELECT count(*) AS n_scored FROM lineitem JOIN part ON l_partkey = p_partkey")
def fit_scored_rows(spark, sf_dir):
    """What ``fit_time`` scores, without the seconds."""
    return fit_time(spark, sf_dir).select("n_scored")


@query("stamp_run_at", oracle=f"""
SELECT '2024-01-05 00:14:47' AS timestamp, 'linear_regression' AS model, m.*, CAST(42 AS INTEGER) AS random_seed,
       CAST(0.2 AS DOUBLE) AS test_size, CAST(100 AS INTEGER) AS epochs, CAST(32 AS INTEGER) AS batch_size
FROM ({ORACLES['regression_metrics']}) m""")
def stamp_run_at(spark, sf_dir):
    """``stamp_run`` with the stamp as a parameter."""
    return _stamped(spark, sf_dir, "2024-01-05 00:14:47")


@query("linreg_ols_two", oracle="""
WITH r AS (SELECT l_quantity * 1e9 AS x, l_discount AS z, l_extendedprice AS y FROM lineitem),
m AS (SELECT var_pop(x / 1e9) AS sxx, var_pop(z) AS szz, covar_pop(x / 1e9, z) AS sxz, covar_pop(x / 1e9, y) AS sxy,
             covar_pop(z, y) AS szy, avg(x / 1e9) AS mx, avg(z) AS mz, avg(y) AS my FROM r),
b AS (SELECT *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS bx, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS bz FROM m)
SELECT round(my - bx * mx - bz * mz, 4) AS intercept, round(bx, 4) AS per_unit, round(bz, 4) AS per_discount FROM b""")
def linreg_ols_two(spark, sf_dir):
    """Two features of very different size (a duration in nanoseconds and a rate)."""
    li = SI.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * F.lit(1e9)).alias("x"), "l_discount", "l_extendedprice")
    m = models.linreg_ols(li, ["x", "l_discount"], "l_extendedprice")
    return spark.createDataFrame([(round(m.intercept, 4), round(m.coefficients["x"] * 1e9, 4), round(m.coefficients["l_discount"], 4))],
                                 "intercept double, per_unit double, per_discount double")
