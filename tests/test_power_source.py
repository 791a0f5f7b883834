"""Power logs as a data source: batch, ranges of bytes, and logs that appear and grow."""

import datetime as dt
import os
import random

import pyarrow as pa
import pytest

from wattframe.plans import q_sources
from wattframe.sources import power_source as P
from wattframe.sources import readers
from wattframe.streaming import meter

SYSTEM = "Date,CPU Utilization,Total Power,CPU Power,GPU Power\n"
PROCESS = "Date,CPU Utilization,CPU Power\n"


def system_lines(a, b):
    return "".join(f"2024-1-5 0:{i // 60:02d}:{i % 60:02d}.{i},0.5,{i}.25,{'' if i % 7 == 3 else i},1.0\n" for i in range(a, b))


def process_lines(a, b):
    return "".join(f'"2024-1-5 0:{i // 60:02d}:{i % 60:02d}.{i}",0.5,{i}.5\n' for i in range(a, b))


def write(folder, name, text, mode="w"):
    os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
    with open(os.path.join(folder, name), mode) as f:
        f.write(text)


def rows(df):
    return sorted((tuple(r) for r in df.drop("file").collect()), key=str)


def test_same_rows_as_the_batch_reader_in_any_ranges(spark, tmp_dir):
    for run in range(3):
        write(tmp_dir, f"run_{run}_repetition_{run}.csv", SYSTEM + system_lines(0, 50 + run))
        write(tmp_dir, f"run_{run}_repetition_{run}.csv-{42 + run}.csv", PROCESS + process_lines(0, 20))
    write(tmp_dir, "run_9_repetition_0.csv", SYSTEM)                            # no samples
    write(tmp_dir, "notes.csv", "not a log\n")
    write(tmp_dir, "run_4_repetition_1.csv", SYSTEM + system_lines(0, 3)[:-1])  # no line break at the end
    want = rows(readers.scan_power_logs(spark, tmp_dir))
    for range_bytes in (1 << 20, 700, 97):
        assert rows(P.scan(spark, tmp_dir, range_bytes=range_bytes)) == want


def test_run_numbers_beyond_32_bits(spark, tmp_dir):
    write(tmp_dir, "run_3000000000_repetition_5000000000.csv-6000000000.csv", PROCESS + process_lines(0, 2))
    assert {tuple(r)[:3] for r in P.scan(spark, tmp_dir).collect()} == {(3_000_000_000, 5_000_000_000, 6_000_000_000)}


def test_names():
    assert P.log_of("/x/run_1_repetition_2.csv") == (1, 2, None)
    assert P.log_of("/x/log=run_1_repetition_2.csv-7.csv/part-0.csv") == (1, 2, 7)
    assert P.log_of("/x/run_1_repetition_2.csv/_SUCCESS") is None
    assert P.log_of("/x/run_1_repetition_2.csv/.part-0.csv.crc") is None
    assert P.log_of("/x/other_run_1_repetition_2.csv") is None


class Source:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_every_line_is_in_one_range(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        data = "".join("x" * rng.randrange(12) + "\n" for _ in range(rng.randrange(12))).encode() + b"y" * rng.randrange(4)
        monkeypatch.setattr(P, "TAIL", rng.randrange(1, 9))
        monkeypatch.setattr(P, "READ_BYTES", rng.randrange(1, 9))
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(4))})
        for a, b in zip(cuts, cuts[1:]):
            got = b"".join(P.lines_of(Source(data), a, b))
            starts = [i for i in range(a, b) if i == 0 or data[i - 1 : i] == b"\n"]
            want = b"".join(data[i : (data.find(b"\n", i) + 1) or len(data)] for i in starts)
            assert got == want, (data, a, b)


def test_empty_folder_and_unreadable_times(spark, tmp_dir):
    with pytest.raises(Exception, match="no power logs"):
        P.scan(spark, tmp_dir).collect()
    write(tmp_dir, "run_1_repetition_0.csv", SYSTEM + "yesterday,0.5,3.0,2.0,1.0\n" + system_lines(0, 1))
    assert P.scan(spark, tmp_dir, bad_times="drop").count() == 1
    with pytest.raises(Exception, match="unreadable time"):
        P.scan(spark, tmp_dir).select("ts").collect()


def test_logs_that_appear_and_grow(spark, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, p) for p in ("src", "sink", "ckpt"))

    def run(i):
        meter.start_to_folder(P.follow(spark, src, range_bytes=300), sink, ckpt, f"follow{i}", mode="append")

    write(src, "run_1_repetition_0.csv", SYSTEM + system_lines(0, 10) + "2024-1-5 0:0")     # the meter is in the middle of a line
    run(0)
    assert len(rows(spark.read.parquet(sink))) == 10
    write(src, "run_1_repetition_0.csv", "0:10.10,0.5,1.0,2.0,3.0\n" + system_lines(11, 30), "a")
    write(src, "run_2_repetition_0.csv-8.csv", PROCESS + process_lines(0, 5))
    run(1)
    run(2)                                                                                 # nothing new
    write(src, "run_2_repetition_0.csv-8.csv", process_lines(5, 9), "a")
    run(3)
    assert rows(spark.read.parquet(sink).drop("batch_id")) == rows(readers.scan_power_logs(spark, src))
    # each sample was read once: the batches hold what was new
    sizes = {r["batch_id"]: r["count"] for r in spark.read.parquet(sink).groupBy("batch_id").count().collect()}
    assert sorted(sizes.values()) == [4, 10, 25]


def test_written_logs_are_a_file_each_whatever_the_partitions(spark, tmp_dir):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i // 60, i % 60), i % 7 if i % 50 else None, "x", float(i), '{"k": 2}') for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.repartition(12).write.parquet(os.path.join(tmp_dir, "events.parquet"))
    root = q_sources._written_power_logs(spark, tmp_dir)
    files = [os.path.join(d, f) for d, _, names in os.walk(P.open_path(root)[1]) for f in names if P.log_of(os.path.join(d, f))]
    assert len(files) == len({os.path.dirname(f) for f in files})
    assert len(files) == 14
    want = [(r[2], None if layout else float(r[4] + 2), r[4], None if layout else 2.0) for r in rows if r[2] is not None for layout in (0, 1)]
    for out in (P.scan(spark, root), q_sources.scan_power_logs(spark, tmp_dir)):
        assert sorted(map(tuple, out.select("run", "total_w", "cpu_w", "gpu_w").collect()), key=str) == sorted(want, key=str)


def test_a_task_that_is_run_again_replaces_its_part(tmp_dir, monkeypatch):
    class Context:
        def __init__(self, attempt):
            self.partitionId, self.taskAttemptId = lambda: 3, lambda: attempt

    writer = P.PowerLogWriter(tmp_dir, "w")
    batch = pa.RecordBatch.from_pydict({"log": ["run_1_repetition_0.csv"] * 2 + ["run_2_repetition_0.csv"], "Date": ["a", None, "c"]})
    for attempt in (1, 2):
        monkeypatch.setattr(P.TaskContext, "get", classmethod(lambda cls, a=attempt: Context(a)))
        assert writer.write(iter([batch, batch.slice(2)])).rows == 4
    found = {os.path.relpath(os.path.join(d, f), tmp_dir): open(os.path.join(d, f)).read() for d, _, names in os.walk(tmp_dir) for f in names}
    assert found == {"log=run_1_repetition_0.csv/part-w-00003.csv": "Date\na\n\n", "log=run_2_repetition_0.csv/part-w-00003.csv": "Date\nc\nc\n"}
    writer.abort([])
    assert not [f for _, _, names in os.walk(tmp_dir) for f in names]
