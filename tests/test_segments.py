"""Energy of samples in any order; the keyed sink."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattframe.operators import energy
from wattframe.streaming import meter, segments
from wattframe.streaming.keyed_sink import KeyedSink

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "run long, seq long, ts timestamp_ntz, w double, g double"


def samples_of(rng, runs, n, hours):
    rows = []
    for run in range(runs):
        for i in range(n):
            w = rng.choice([None, float("nan"), 1.0, 2.5, 4.0]) if rng.random() < 0.3 else rng.random() * 9
            rows.append((run, i, T0 + dt.timedelta(seconds=rng.randrange(hours * 3600)), w, float(run)))
    return rows


def batch_energy(spark, rows):
    out = energy.energy_per_run(spark.createDataFrame(rows, SCHEMA), ["run"], ["w", "g"], order_cols=["seq"])
    return {r["run"]: (r["n_samples"], r["w_energy_j"], r["g_energy_j"]) for r in out.collect()}


def stream(spark, folder, slices, name, **settings):
    """One query over slices that appear one after another, a file to a micro-batch."""
    src, sink, ckpt = (os.path.join(folder, p) for p in ("src", "sink", "ckpt"))
    stream_in = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "slice_*"))
    kept = KeyedSink(spark, sink, ["run", "bucket"], compact_every=3)
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(src, f"slice_{i}"))
        segments.start_with_rocksdb(spark, lambda: meter.start_to_folder(
            segments.stream_segments(stream_in, ["run"], ["w", "g"], "ts", "seq", **settings), sink, ckpt, f"{name}{i}", kept.write))
    return kept.read()


def test_interleaved_slices_equal_the_batch(spark, tmp_dir):
    rng = random.Random(2)
    rows = samples_of(rng, 4, 60, 100)
    rows += [(9, 0, T0, 3.0, 1.0)]                                        # one sample: no energy
    rows += [(0, 1000 + i, T0 + dt.timedelta(hours=2), 2.0, 1.0) for i in range(20)]   # equal times
    rng.shuffle(rows)
    found = stream(spark, tmp_dir, [rows[i::4] for i in range(4)], "mix", bucket_ms=10 * 3600 * 1000, lateness_ms=200 * 3600 * 1000)
    got = {r["run"]: r for r in segments.run_energy(found, ["run"], ["w", "g"]).collect()}
    want = batch_energy(spark, [(r, s, t, None if w is not None and np.isnan(w) else w, g) for r, s, t, w, g in rows])
    assert set(got) == set(want)
    for run, (n, w, g) in want.items():
        assert (got[run]["n_samples"], got[run]["late_samples"]) == (n, 0)
        assert got[run]["w_energy_j"] == pytest.approx(w) and got[run]["g_energy_j"] == pytest.approx(g)


def test_after_sealing(spark, tmp_dir):
    hour = dt.timedelta(hours=1)

    def sample(seq, hours, w):
        return (1, seq, T0 + hours * hour, w, 1.0)

    slices = [[sample(0, 1, 2.0), sample(1, 2, 4.0), sample(2, 3, 6.0)],
              [sample(3, 100, 1.0)],                     # moves the watermark: the first day is sealed
              [sample(4, 101, 1.0)],
              [sample(5, 2.5, 9.0),                      # inside the sealed segment: counted
               sample(6, 5, 3.0), sample(7, 0.5, 8.0)]]  # after and before it: applied
    found = stream(spark, tmp_dir, slices, "seal", lateness_ms=3600 * 1000)
    days = {r["bucket"] - min(x["bucket"] for x in found.collect()): r for r in found.collect()}
    assert days[0]["closed"] and (days[0]["n_samples"], days[0]["late_samples"]) == (5, 1)
    assert not days[4]["closed"] and days[4]["n_samples"] == 2
    [got] = segments.run_energy(found, ["run"], ["w", "g"]).collect()
    want = batch_energy(spark, [r for s in slices for r in s if r[1] != 5])[1]
    assert (got["n_samples"], got["late_samples"]) == (want[0], 1)
    assert got["w_energy_j"] == pytest.approx(want[1]) and got["g_energy_j"] == pytest.approx(want[2])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.one_of(st.just(float("nan")), st.floats(0, 100))), min_size=1, max_size=40), st.integers(1, 6))
def test_segments_merge_exactly(rows, parts):
    us = np.array([r[0] * 1_000_000 for r in rows], np.int64)
    seq, power = np.arange(len(rows)), np.array([[r[1]] for r in rows])
    whole = segments.Segment.of(us, seq, power)
    order = np.lexsort((seq, us))
    cut = [segments.Segment.of(us[i], seq[i], power[i]) for i in np.array_split(order, parts) if len(i)]
    again = segments.merged(cut[::-1])
    assert (again.first, again.last, again.n) == (whole.first, whole.last, whole.n)
    assert again.start_power == whole.start_power and again.body == pytest.approx(whole.body)
    assert segments.Segment.from_row(whole.row()) == whole


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 50), st.one_of(st.just(float("nan")), st.floats(0, 100))), min_size=1, max_size=40))
def test_segments_of_many_runs_at_once(rows):
    run, us = np.array([r[0] for r in rows], object), np.array([r[1] * 1_000_000 for r in rows], np.int64)
    seq, power = np.arange(len(rows)), np.array([[r[2], 1.0] for r in rows])
    got = {r[0]: segments.Segment.from_row(r[1:]) for r in segments.run_segments(run, us, seq, power).itertuples(index=False, name=None)}
    assert set(got) == set(run)
    for name, s in got.items():
        want = segments.Segment.of(us[run == name], seq[run == name], power[run == name])
        assert (s.first, s.last, s.n, s.start_power) == (want.first, want.last, want.n, want.start_power) and s.body == pytest.approx(want.body)


def test_many_runs_share_a_key(spark, tmp_dir, monkeypatch):
    queries, start = [], meter.start_to_folder
    monkeypatch.setattr(meter, "start_to_folder", lambda *args, **kw: queries.append(start(*args, **kw)) or queries[-1])
    rows = [(run if run else None, i, T0 + dt.timedelta(minutes=(7 * i + run) % 600), float(i), 1.0) for run in range(200) for i in range(4)]
    found = stream(spark, tmp_dir, [rows[0::2], rows[1::2]], "share", shards=2)
    # state is touched per shard, not per run
    assert max(op.numRowsUpdated for q in queries for p in q.recentProgress for op in p.stateOperators) < 20
    got = {r["run"]: r for r in segments.run_energy(found, ["run"], ["w", "g"]).collect()}
    want = batch_energy(spark, rows)
    assert {r: x["n_samples"] for r, x in got.items()} == {r: x[0] for r, x in want.items()}
    assert all(got[r]["w_energy_j"] == pytest.approx(x[1]) and got[r]["g_energy_j"] == pytest.approx(x[2]) for r, x in want.items())


def test_place_among_sealed_segments():
    def seg(a, b):
        return segments.Segment((a, 0), (b, 0), 2, (0.0,), (0.0,))

    us = np.array([0, 10, 15, 20, 25, 30, 99])
    assert segments.apart(us, np.zeros(7, int), [seg(10, 20), seg(30, 40)]).tolist() == [0, -1, -1, -1, 1, -1, 2]
    assert segments.apart(us, np.zeros(7, int), []).tolist() == [0] * 7


# ---- keyed sink

def current(sink):
    return {r["k"]: r["v"] for r in sink.read().collect()}


def files_read(sink):
    return len(sink.read().inputFiles())


def test_reading_does_not_grow_with_the_number_of_batches(spark, tmp_dir):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        sink, want, seen = KeyedSink(spark, os.path.join(tmp_dir, "sink"), ["k"], compact_every=20), {}, []
        for b in range(200):
            rows = [(b % 7, float(b)), (100 + b % 11, float(-b))]
            want.update(dict(rows))
            sink.write(spark.createDataFrame(rows, "k long, v double").coalesce(1), b)
            if b % 40 == 39:
                seen.append(files_read(sink))
                assert current(sink) == want
        assert max(seen) <= 20 + 2 and len(sink._batches()) <= 2 * 20
        assert len(sink._list("snapshots")) <= 2 and len(sink.manifests()) <= 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_crash_at_any_step_loses_nothing(spark, tmp_dir, monkeypatch):
    sink = KeyedSink(spark, os.path.join(tmp_dir, "sink"), ["k"], compact_every=2)

    def batch(b):
        return spark.createDataFrame([(1, f"v{b}"), (b, "own")], "k long, v string")

    sink.write(batch(10), 0)
    # the clean-up fails after the manifest is there
    with monkeypatch.context() as m:
        m.setattr(KeyedSink, "_clean", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sink.write(batch(11), 1)
    assert current(sink) == {1: "v11", 10: "own", 11: "own"}
    sink.write(batch(11), 1)                                # the batch is retried
    assert current(sink) == {1: "v11", 10: "own", 11: "own"}
    # the snapshot is written, its manifest is not
    with monkeypatch.context() as m:
        m.setattr(KeyedSink, "_fs", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sink.write(batch(12), 2)
    sink.write(batch(12), 2)
    for b in range(3, 9):
        sink.write(batch(10 + b), b)
    assert current(sink) == {1: "v18", **{10 + b: "own" for b in range(9)}}


def test_an_empty_sink_and_null_keys(spark, tmp_dir):
    sink = KeyedSink(spark, os.path.join(tmp_dir, "sink"), ["k"], compact_every=2)
    with pytest.raises(FileNotFoundError):
        sink.read()
    for b in range(5):
        sink.write(spark.createDataFrame([(None, b)], "k long, v long"), b)
    assert current(sink) == {None: 4}
