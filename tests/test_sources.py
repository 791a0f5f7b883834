import datetime as dt
import json
import os

import pytest

from wattframe.sources import readers, sinks


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_power_logs_two_layouts(spark, tmp_dir):
    # a system log (5 columns) and a per-process log (3 columns) in one folder
    _write(os.path.join(tmp_dir, "run_1_repetition_0.csv"),
           "Date,CPU Utilization,Total Power,CPU Power,GPU Power\n"
           "2025-3-7 0:14:46.8,0.5,3.0,3.0,0.0\n2025-3-7 0:14:47.10,0.6,3.5,3.5,0.0\n")
    _write(os.path.join(tmp_dir, "run_1_repetition_0.csv-181500.csv"),
           "Date,CPU Utilization,CPU Power\n2025-3-7 0:14:46.8,0.25,1.25\n2025-3-7 0:14:47.10,0.3,1.5\n"
           "2025-3-7 0:14:48.12,0.35,1.75\n")
    df = readers.scan_power_logs(spark, tmp_dir)
    rows = df.orderBy("layout", "ts").collect()
    proc = [r for r in rows if r["layout"] == "process"]
    sysr = [r for r in rows if r["layout"] == "system"]
    assert len(proc) == 3 and len(sysr) == 2
    assert all(r["run"] == 1 and r["rep"] == 0 for r in rows)
    assert {r["pid"] for r in proc} == {181500} and {r["pid"] for r in sysr} == {None}
    # CPU power of the 3-column file is not read as total power
    assert [r["cpu_w"] for r in proc] == [1.25, 1.5, 1.75]
    assert all(r["total_w"] is None for r in proc)
    assert [r["total_w"] for r in sysr] == [3.0, 3.5]
    assert proc[1]["ts"] == dt.datetime(2025, 3, 7, 0, 14, 47, 10000)


def test_headerless_power_and_empty(spark, tmp_dir):
    p = os.path.join(tmp_dir, "cpu_power.csv")
    _write(p, "2024-05-01 20:29:44,0.12,5.5,1.5,4.0\n")
    df = readers.scan_csv_headerless(spark, p, readers.headerless_power_schema())
    r = df.first()
    assert r["Date"] == dt.datetime(2024, 5, 1, 20, 29, 44) and r["Total_P"] == 5.5 and r["GPU_P"] == 4.0
    empty = os.path.join(tmp_dir, "empty.csv")
    _write(empty, "")
    with pytest.raises(ValueError):
        readers.scan_csv_headerless(spark, empty, readers.headerless_power_schema())


def test_run_table_blank_first_line(spark, tmp_dir):
    p = os.path.join(tmp_dir, "run_table.csv")
    _write(p, "\n__run_id,__done,Block_Type,Library_Name,Timestamp_Start,Total_Energy_J,CPU_Energy_J,GPU_Energy_J,"
              "Time_Taken_s,Accuracy_Pct,Model_Name\n"
              "run_0_repetition_0,DONE,PT_CPU,PT,2025-01-02 10:00:00,10.5,1.5,9.0,8.4,97.3684,NN\n"
              "run_1_repetition_0,DONE,TF_CPU,TF,FAILED,15.0,2.0,13.0,11.7,96.4912,NN\n")
    df = readers.scan_run_table(spark, p, "laptop")
    rows = df.orderBy("__run_id").collect()
    assert len(df.columns) == 11 and len(rows) == 2
    assert rows[0]["Timestamp_Start"] == dt.datetime(2025, 1, 2, 10, 0, 0)
    assert rows[1]["Timestamp_Start"] is None
    assert rows[0]["Total_Energy_J"] == 10.5


def test_run_order(spark, tmp_dir):
    p = os.path.join(tmp_dir, "run_order.csv")
    _write(p, "ml_library\nPT\nTF\nPT\n")
    rows = readers.scan_run_order(spark, p).orderBy("pos").collect()
    assert [(r["pos"], r["ml_library"]) for r in rows] == [(0, "PT"), (1, "TF"), (2, "PT")]
    assert readers.scan_run_order(spark, p, "missing").count() == 0
    assert readers.scan_run_order(spark, os.path.join(tmp_dir, "nope.csv")).count() == 0


def test_json_array_records(spark, tmp_dir):
    p = os.path.join(tmp_dir, "metrics.json")
    _write(p, json.dumps([{"timestamp": "2025-01-02 10:00:00", "model": "lin", "MSE": 1.5, "r2_score": 0.5},
                          {"timestamp": "2025-01-02 10:05:00", "model": "lin", "MSE": 1.25, "r2_score": 0.6}],
                         indent=4))
    df = readers.scan_json_records(spark, p)
    assert df.count() == 2
    m = readers.normalise_metrics(df).orderBy("timestamp").collect()
    assert m[1]["MSE"] == 1.25 and m[1]["accuracy"] is None


def test_append_metrics_layouts(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    a = spark.createDataFrame([("2025-01-02 10:00:00", "logreg", 0.9, 0.8, 0.7, 0.75)],
                              "timestamp string, model string, accuracy double, precision double, recall double, f1 double")
    b = spark.createDataFrame([("2025-01-02 11:00:00", "logreg", 0.95, 0.6, 0.65, 2)],
                              "timestamp string, model string, accuracy double, recall double, f1_score double, num_classes int")
    sinks.append_metrics_csv(a, path)
    sinks.append_metrics_csv(b, path)
    back = readers.scan_metrics_log(spark, path).orderBy("timestamp").collect()
    assert len(back) == 2
    assert back[0]["precision"] == 0.8 and back[1]["precision"] is None
    assert back[1]["f1"] == 0.65 and back[1]["num_classes"] == 2


def test_long_repetition_numbers_are_read(spark, tmp_path):
    body = "Date,CPU Utilization,Total Power,CPU Power,GPU Power\n2024-1-5 0:14:47.10,0.5,3.0,2.0,1.0\n"
    for rep in (0, 1234567):
        (tmp_path / f"run_1_repetition_{rep}.csv").write_text(body)
    (tmp_path / "run_1_repetition_0.csv-42.csv").write_text("Date,CPU Utilization,CPU Power\n2024-1-5 0:14:47.10,0.5,2.0\n")
    got = {(r["rep"], r["layout"], r["pid"], r["total_w"]) for r in readers.scan_power_logs(spark, str(tmp_path)).collect()}
    assert got == {(0, "system", None, 3.0), (1234567, "system", None, 3.0), (0, "process", 42, None)}


def test_unreadable_times_are_an_error_or_left_out(spark, tmp_path):
    (tmp_path / "run_1_repetition_0.csv").write_text(
        "Date,CPU Utilization,Total Power,CPU Power,GPU Power\n2024-1-5 0:14:47.10,0.5,3.0,2.0,1.0\nyesterday,0.5,3.0,2.0,1.0\n")
    assert readers.scan_power_logs(spark, str(tmp_path), bad_times="drop").count() == 1
    with pytest.raises(Exception, match="unreadable time"):
        readers.scan_power_logs(spark, str(tmp_path)).select("ts").collect()


def test_model_names_survive_the_metrics_log(spark, tmp_path):
    df = spark.createDataFrame([("007", 0.5), ("1e3", 0.25)], "model string, accuracy double")
    sinks.append_metrics_csv(df, f"{tmp_path}/c")
    sinks.append_metrics_json(df, f"{tmp_path}/j")
    for path, fmt in ((f"{tmp_path}/c", "csv"), (f"{tmp_path}/j", "json")):
        assert sorted((r["model"], r["accuracy"]) for r in readers.scan_metrics_log(spark, path, fmt).collect()) == [("007", 0.5), ("1e3", 0.25)]


def test_json_array_files_and_empty_partitions(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "timestamp_ntz'2024-01-05 00:14:47.123456' AS t").repartition(7)
    sinks.write_json_array(df, f"{tmp_path}/a")
    assert sorted(r["id"] for r in readers.scan_json_records(spark, f"{tmp_path}/a", df.schema).collect()) == list(range(5))
    assert readers.scan_json_records(spark, f"{tmp_path}/a", df.schema).select("t").distinct().count() == 1


def test_meter_time_with_more_digits(spark):
    from wattframe.functions import scalars as S
    df = spark.createDataFrame([("2024-1-5 0:14:47.123456",), ("2024-1-5 0:14:47.1234567890123",), ("2024-1-5 0:14:47.8",)], "d string")
    got = [str(r[0]) for r in df.select(S.parse_power_time("d")).collect()]
    assert got == ["2024-01-05 00:14:47.123456", "2024-01-05 00:14:47.123456", "2024-01-05 00:14:47.008000"]
