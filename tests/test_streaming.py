import datetime as dt
import os

import pytest

from wattframe.operators import energy
from wattframe.plans import q_stream, standins
from wattframe.streaming import meter

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "run long, seq long, ts timestamp_ntz, w double"


def test_stream_energy_late_sample_and_batch_equality(spark, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, p) for p in ("src", "sink", "ckpt"))
    first = [(1, 0, T0, 2.0), (1, 1, T0 + dt.timedelta(seconds=1), 4.0), (2, 0, T0, 1.0)]
    second = [(1, 2, T0 + dt.timedelta(seconds=3), 6.0),
              (1, 3, T0 + dt.timedelta(milliseconds=500), 9.0),   # late: before run 1's last sample
              (2, 1, T0 + dt.timedelta(seconds=10), 1.0)]
    stream_in = spark.readStream.schema(SCHEMA).parquet(os.path.join(src, "slice_*"))
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(os.path.join(src, f"slice_{i}"))
        meter.start_to_folder(meter.stream_energy(stream_in, ["run"], ["w"], "ts", "seq"), sink, ckpt, f"t{i}")
    out = {r["run"]: r for r in meter.read_latest(spark, sink, ["run"]).collect()}
    # run 1 applies 2, 4, 6 W at 0, 1, 3 s (19 J); the late sample is counted, not applied
    assert out[1]["n_samples"] == 3 and out[1]["late_samples"] == 1
    assert out[1]["w_energy_j"] == pytest.approx(19.0)
    on_time = spark.createDataFrame([r for r in first + second if r[:2] != (1, 3)], SCHEMA)
    batch = {r["run"]: r["w_energy_j"] for r in energy.energy_per_run(on_time, ["run"], ["w"], order_cols=["seq"]).collect()}
    assert out[2]["w_energy_j"] == pytest.approx(batch[2])
    assert out[1]["w_energy_j"] == pytest.approx(batch[1])


def test_stream_energy_idle_runs_close(spark, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, p) for p in ("src", "sink", "ckpt"))
    first = [(1, 0, T0, 2.0), (1, 1, T0 + dt.timedelta(seconds=1), 4.0), (2, 0, T0, 1.0)]
    second = [(2, 1, T0 + dt.timedelta(seconds=100), 1.0)]
    third = [(2, 2, T0 + dt.timedelta(seconds=101), 1.0)]
    stream_in = spark.readStream.schema(SCHEMA).parquet(os.path.join(src, "slice_*"))
    for i, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(os.path.join(src, f"slice_{i}"))
        q = meter.stream_energy(stream_in, ["run"], ["w"], "ts", "seq", idle_timeout_ms=10_000)
        meter.start_to_folder(q, sink, ckpt, f"idle{i}")
    out = {r["run"]: r for r in meter.read_latest(spark, sink, ["run"]).collect()}
    # run 1 had no sample for more than 10 s of event time: closed with its final energy
    assert out[1]["closed"] and out[1]["n_samples"] == 2
    assert out[1]["w_energy_j"] == pytest.approx(2.0 * 1.0 + 4.0 * 1.0)
    assert not out[2]["closed"] and out[2]["n_samples"] == 3


def test_a_week_in_many_micro_batches_is_whole(spark, tmp_dir, monkeypatch):
    # one file a micro-batch; each file of a week holds the whole week of other runs
    monkeypatch.setattr(q_stream, "FILES_PER_TRIGGER", 1)
    rows = [(100 * run + i, T0 + dt.timedelta(hours=6 * i + run % 5, seconds=run), run, "x", float(run + i % 7), '{"k": 2}')
            for run in range(12) for i in range(60)]  # fifteen days of each run
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(os.path.join(tmp_dir, "events.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["run_id"]: r for r in q_stream.stream_energy(spark, tmp_dir).collect()}
        windows = {(r["run_id"], r["window_start"]): (r["n_samples"], r["max_w"])
                   for r in q_stream.stream_power_windows(spark, tmp_dir).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    batch = energy.energy_per_run(standins.power_samples(spark, tmp_dir), ["run_id"], ["cpu_w", "gpu_w"], order_cols=["seq"])
    for r in batch.collect():
        got = found[r["run_id"]]
        assert (got["n_samples"], got["late_samples"]) == (60, 0)
        assert got["cpu_w_energy_j"] == pytest.approx(r["cpu_w_energy_j"]) and got["gpu_w_energy_j"] == pytest.approx(r["gpu_w_energy_j"])
    want = {}
    for _, ts, run, _, value, _ in rows:
        key = (run, ts.replace(hour=0, minute=0, second=0))
        n, top = want.get(key, (0, 0.0))
        want[key] = (n + 1, max(top, value))
    assert windows == want


def test_samples_behind_the_watermark_are_counted(spark, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, p) for p in ("src", "sink", "ckpt"))
    day = dt.timedelta(days=1)
    slices = [[(1, 0, T0 + 9 * day, 2.0), (1, 1, T0 + 10 * day, 4.0)],
              [(1, 2, T0 + 11 * day, 4.0)],
              [(1, 3, T0 + 2 * day, 9.0), (1, 4, T0 + 12 * day, 4.0),   # one sample far behind the watermark
               (2, 0, T0, 1.0), (2, 1, T0 + day, 1.0)]]                 # a run that is behind it as a whole
    stream_in = spark.readStream.schema(SCHEMA).parquet(os.path.join(src, "slice_*"))
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(src, f"slice_{i}"))
        meter.start_to_folder(meter.stream_energy(stream_in, ["run"], ["w"], "ts", "seq"), sink, ckpt, f"behind{i}")
    out = {r["run"]: r for r in meter.read_latest(spark, sink, ["run"]).collect()}
    assert (out[1]["n_samples"], out[1]["late_samples"]) == (4, 1)
    assert (out[2]["n_samples"], out[2]["late_samples"]) == (2, 0)


def test_windows_that_lose_samples_are_reported(spark, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, p) for p in ("src", "sink", "ckpt"))
    stream_in = spark.readStream.schema(SCHEMA).parquet(os.path.join(src, "slice_*"))
    lost = []
    for i, day in enumerate((10, 11, 2)):
        spark.createDataFrame([(1, i, T0 + dt.timedelta(days=day), 2.0)], SCHEMA).write.parquet(os.path.join(src, f"slice_{i}"))
        q = meter.start_to_folder(meter.stream_power_windows(stream_in, ["run"], "w", "ts", "1 day", "1 day"), sink, ckpt, f"lost{i}")
        lost.append(q.rows_behind_watermark)
    assert lost == [0, 0, 1]
