"""Plan shape: pruning, pushdown, partitioning; a hot key does not change results."""

import contextlib
import datetime as dt
import io
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattframe.operators import energy, ranking, split
from wattframe.plans import q_energy, q_runs

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_flagship_prunes_columns(spark):
    plan = _plan(q_energy.board_energy_summary_df(spark, SF))
    read = [ln for ln in plan.splitlines() if "ReadSchema" in ln]
    assert read and all("props" not in ln for ln in read)
    # energy windows are partitioned by run and time chunk, never by nothing
    assert "_chunk" in plan
    assert "SinglePartition" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_filters_reach_the_scan(spark):
    plan = _plan(q_runs.union_platforms(spark, SF))
    pushed = [ln for ln in plan.splitlines() if "PushedFilters" in ln]
    assert any("l_linestatus" in ln for ln in pushed)


def test_hot_run_energy_matches_brute_force(spark):
    # one run holds about a third of all samples and spans many chunks
    rng = np.random.default_rng(5)
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for run, n in ((0, 3000), (1, 1500), (2, 1500), (3, 1000), (4, 1000)):
        gaps = rng.integers(1, 30, size=n).cumsum()
        for i, g in enumerate(gaps):
            rows.append((run, i, t0 + dt.timedelta(seconds=int(g), microseconds=int(rng.integers(0, 999999))),
                         float(rng.integers(0, 500)) / 10))
    df = spark.createDataFrame(rows, "run long, seq long, ts timestamp_ntz, w double")
    got = {r["run"]: r["w_energy_j"] for r in energy.energy_per_run(df, ["run"], ["w"], order_cols=["seq"],
                                                                      chunk_seconds=600).collect()}
    pdf = pd.DataFrame(rows, columns=["run", "seq", "ts", "w"]).sort_values(["run", "ts", "seq"])
    for run, part in pdf.groupby("run"):
        d = part["ts"].diff().dt.total_seconds().to_numpy().copy()
        d[0] = d[1:].mean()
        assert got[run] == pytest.approx(float((part["w"].to_numpy() * d).sum()), rel=1e-9)


@pytest.mark.parametrize("gap", [7200, 0.001])
def test_hot_run_sparse_or_dense_is_spread(spark, gap):
    # a third of all samples in one run, one sample in two hours or all within seconds
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, i, t0 + dt.timedelta(seconds=gap * i), 1.0 + i % 3) for i in range(4000)]
    rows += [(1 + i % 400, i, t0 + dt.timedelta(seconds=i), 2.0) for i in range(8000)]
    df = spark.createDataFrame(rows, "run long, seq long, ts timestamp_ntz, w double")
    chunks = ranking.by_range(df, ["run", "ts", "seq"], 24, "_chunk").groupBy("run", "_chunk").count()
    assert chunks.agg({"count": "max"}).first()[0] < 1500
    got = {r["run"]: r["w_energy_j"] for r in energy.energy_per_run(df, ["run"], ["w"], order_cols=["seq"]).collect()}
    want = sum((1.0 + i % 3) * gap for i in range(1, 4000)) + 1.0 * gap
    assert got[0] == pytest.approx(want, rel=1e-6)


def test_zero_heavy_values_are_spread_and_null_groups_kept(spark):
    vals = [("a", 0.0)] * 9900 + [("a", float(i)) for i in range(1, 2001)] + [("n", None)] * 3 + [(None, 5.0)]
    df = spark.createDataFrame(vals, "g string, v double")
    counts = ranking.value_counts(df, "v", ["g"], 8)
    assert counts.groupBy("_b").count().agg({"count": "max"}).first()[0] < 600
    q = {r["g"]: r["med"] for r in ranking.exact_quantiles(df, "v", {"med": 0.5}, ["g"]).collect()}
    assert q == {"a": 0.0, "n": None, None: 5.0}


def test_hot_group_quantiles_exact(spark):
    rng = np.random.default_rng(9)
    vals = [("hot", float(v)) for v in rng.normal(100, 5, 6000)] + \
           [("cold", float(v)) for v in rng.normal(0, 1, 300)]
    df = spark.createDataFrame(vals, "g string, v double")
    q = {r["g"]: r for r in ranking.exact_quantiles(df, "v", {"med": 0.5, "q3": 0.75}, ["g"]).collect()}
    hot = np.array([v for g, v in vals if g == "hot"])
    assert q["hot"]["med"] == pytest.approx(np.quantile(hot, 0.5))
    assert q["hot"]["q3"] == pytest.approx(np.quantile(hot, 0.75))


def test_exact_split_leaves_rows_in_place(spark):
    """Only the cut buckets' rows, for their window, are shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).select(F.col("id"), (F.col("id") % 3).alias("s"))
        plan = _plan(split.stratified_split(rows, ["id"], "s", 0.2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = plan[: plan.index("(1) ")]
    assert "SortMergeJoin" not in tree and tree.count("BroadcastHashJoin") == 2
    assert len([ln for ln in tree.splitlines() if "Exchange" in ln and "Broadcast" not in ln]) == 1


def test_exact_split_beyond_the_broadcast(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("s"))
    near = split.exact_split(rows, ["id"], 0.3, strata=["s"]).orderBy("id").collect()
    monkeypatch.setattr(split, "MOST_GROUPS", 2)
    assert split.exact_split(rows, ["id"], 0.3, strata=["s"]).orderBy("id").collect() == near
