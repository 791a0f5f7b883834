import datetime as dt

import pytest

from wattframe.functions import scalars as S
from wattframe.operators import energy

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _samples(spark, rows):
    return spark.createDataFrame(rows, "run long, seq long, ts timestamp_ntz, w double")


def test_three_samples_energy(spark):
    # 2, 4, 6 W at 0, 1, 3 s: steps 1.5 (backfilled mean), 1, 2 -> 3 + 4 + 12 = 19 J
    df = _samples(spark, [(1, 0, T0, 2.0), (1, 1, T0 + dt.timedelta(seconds=1), 4.0),
                          (1, 2, T0 + dt.timedelta(seconds=3), 6.0)])
    e = energy.energy_per_run(df, ["run"], ["w"], order_cols=["seq"]).first()
    assert e["w_energy_j"] == pytest.approx(19.0)
    assert e["n_samples"] == 3
    steps = energy.sample_deltas(df, ["run"], order_cols=["seq"]).orderBy("seq").collect()
    assert [r["dt_s"] for r in steps] == [None, 1.0, 2.0]
    assert [r["dt_fill_s"] for r in steps] == [1.5, 1.0, 2.0]


def test_one_sample_is_zero(spark):
    df = _samples(spark, [(7, 0, T0, 5.0)])
    e = energy.energy_per_run(df, ["run"], ["w"], order_cols=["seq"]).first()
    assert e["w_energy_j"] == 0.0


def test_chunking_does_not_change_energy(spark):
    rows = []
    for run in range(3):
        t = T0
        for i in range(200):
            t = t + dt.timedelta(seconds=1 + (i * 7 + run) % 5)
            rows.append((run, i, t, float((i * 13 + run) % 17)))
    df = _samples(spark, rows)
    fine = energy.energy_per_run(df, ["run"], ["w"], order_cols=["seq"], chunk_seconds=7)
    coarse = energy.energy_per_run(df, ["run"], ["w"], order_cols=["seq"], chunk_seconds=10**7)
    a = {r["run"]: r["w_energy_j"] for r in fine.collect()}
    b = {r["run"]: r["w_energy_j"] for r in coarse.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12)
    # per-sample steps also agree across chunk sizes
    s1 = {(r["run"], r["seq"]): r["dt_fill_s"] for r in energy.sample_deltas(df, ["run"], order_cols=["seq"], chunk_seconds=7).collect()}
    s2 = {(r["run"], r["seq"]): r["dt_fill_s"] for r in energy.sample_deltas(df, ["run"], order_cols=["seq"], chunk_seconds=10**7).collect()}
    assert s1.keys() == s2.keys()
    for k in s1:
        assert s1[k] == pytest.approx(s2[k], rel=1e-12)


def test_energy_unchanged_by_repartition(spark):
    rows = [(r, i, T0 + dt.timedelta(seconds=i * 2 + r), float(i % 9)) for r in range(5) for i in range(50)]
    df = _samples(spark, rows)
    a = sorted(tuple(x) for x in energy.energy_per_run(df, ["run"], ["w"], order_cols=["seq"]).select("run", "w_energy_j").collect())
    b = sorted(tuple(x) for x in energy.energy_per_run(df.repartition(7), ["run"], ["w"], order_cols=["seq"]).select("run", "w_energy_j").collect())
    assert [x[0] for x in a] == [x[0] for x in b]
    for x, y in zip(a, b):
        assert x[1] == pytest.approx(y[1], rel=1e-12)


def test_unpadded_time_integer_ms(spark):
    df = spark.createDataFrame([("2025-3-7 0:14:46.8",), ("2025-3-7 0:14:47.10",)], "d string")
    out = df.select(S.parse_power_time("d").alias("t"), S.parse_power_time("d", "decimal").alias("t_dec")).collect()
    assert out[0]["t"] == dt.datetime(2025, 3, 7, 0, 14, 46, 8000)
    assert out[1]["t"] == dt.datetime(2025, 3, 7, 0, 14, 47, 10000)
    assert (out[1]["t"] - out[0]["t"]).total_seconds() == pytest.approx(1.002)
    assert out[0]["t_dec"] == dt.datetime(2025, 3, 7, 0, 14, 46, 800000)


def test_power_time_text_round_trip(spark):
    ts = [dt.datetime(2024, 1, 5, 0, 14, 47, 10000), dt.datetime(2024, 12, 31, 23, 59, 59, 999999)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    out = df.select(S.power_time_text("ts").alias("x")).withColumn("back", S.parse_power_time("x")).collect()
    assert out[0]["x"] == "2024-1-5 0:14:47.10"
    assert out[0]["back"] == dt.datetime(2024, 1, 5, 0, 14, 47, 10000)
    assert out[1]["back"] == dt.datetime(2024, 12, 31, 23, 59, 59, 999000)


def test_constant_step_energy(spark):
    samples = spark.createDataFrame([(1, 10.0, 1.0), (2, 5.0, 0.0)], "run long, cpu double, gpu double")
    runs = spark.createDataFrame([(1, 3.0), (2, 2.0)], "run long, secs double")
    out = {r["run"]: r for r in energy.energy_constant_step(samples, runs, ["run"], "secs", "cpu", "gpu").collect()}
    assert out[1]["cpu_energy_j"] == 30.0 and out[1]["gpu_energy_j"] == 3.0 and out[1]["total_energy_j"] == 33.0
    assert out[2]["total_energy_j"] == 10.0


def test_first_sample(spark):
    df = _samples(spark, [(1, 5, T0 + dt.timedelta(seconds=2), 1.0), (1, 4, T0 + dt.timedelta(seconds=2), 9.0),
                          (1, 9, T0 + dt.timedelta(seconds=5), 3.0)])
    r = energy.first_sample(df, ["run"], ["w"], order_cols=["seq"]).first()
    assert r["start_ts"] == T0 + dt.timedelta(seconds=2)
    assert r["first_w"] == 9.0  # tie on ts broken by seq


def test_steps_do_not_depend_on_session_time_zone(spark):
    # wall-clock samples across the 2024-03-10 US DST change: 01:30 -> 03:30 is 2 h of clock time
    rows = [(1, 0, dt.datetime(2024, 3, 10, 1, 30), 1.0), (1, 1, dt.datetime(2024, 3, 10, 3, 30), 1.0)]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        d = energy.sample_deltas(_samples(spark, rows), ["run"], order_cols=["seq"]).orderBy("seq").collect()
        assert d[1]["dt_s"] == 7200.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_missing_power_values_are_skipped(spark):
    # NULL power contributes nothing (NaN-skipping sum); steps still use every sample's time
    df = _samples(spark, [(1, 0, T0, None), (1, 1, T0 + dt.timedelta(seconds=1), 4.0),
                          (1, 2, T0 + dt.timedelta(seconds=3), None)])
    e = energy.energy_per_run(df, ["run"], ["w"], order_cols=["seq"]).first()
    assert e["w_energy_j"] == pytest.approx(4.0)
