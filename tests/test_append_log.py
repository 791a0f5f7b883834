"""Appends that happen once; run tables with all their columns."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from wattframe.sources import append_log, readers, sinks


def metrics(spark, n, fail_at=None):
    df = spark.range(n, numPartitions=4).select(F.concat(F.lit("m"), "id").alias("model"), (F.col("id") / 2).alias("accuracy"))
    if fail_at is not None:
        df = df.withColumn("accuracy", F.when(F.col("model") == f"m{fail_at}", F.raise_error(F.lit("power cut")).cast("double")).otherwise(F.col("accuracy")))
    return df


def read(spark, path, fmt):
    return sorted((r["model"], r["accuracy"]) for r in readers.scan_metrics_log(spark, path, fmt).collect())


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_a_job_killed_half_way_and_run_again(spark, tmp_dir, fmt):
    append = sinks.append_metrics_csv if fmt == "csv" else sinks.append_metrics_json
    path = os.path.join(tmp_dir, "log")
    append(metrics(spark, 3), path, append_id="run-0")
    for _ in range(2):
        with pytest.raises(Exception, match="power cut"):
            append(metrics(spark, 40, fail_at=33), path, append_id="run-1")
        assert len(read(spark, path, fmt)) == 3          # nothing of it is seen
    for _ in range(3):
        append(metrics(spark, 40), path, append_id="run-1")
    want = sorted([(f"m{i}", i / 2) for i in range(3)] + [(f"m{i}", i / 2) for i in range(40)])
    assert read(spark, path, fmt) == want
    assert sorted(tuple(r) for r in append_log.appends(spark, path).select("append_id", "rows").collect()) == [("run-0", 3), ("run-1", 40)]
    # a task of a dead job may still have written into its own staging; nobody reads there
    assert all(name.startswith("run-1-") for name in os.listdir(os.path.join(path, "_staging")))


def test_files_of_lost_attempts_and_a_second_committer(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    writers = [append_log.AppendWriter(path, "a", ".txt", None) for _ in range(2)]
    for w in writers:
        os.makedirs(w.staging)
        for name in ("part-0-1.txt", "part-0-2.txt"):     # the second attempt's file was not committed
            with open(f"{w.staging}/{name}", "w") as f:
                f.write("x\n")
        w.commit([append_log.FileWritten("part-0-1.txt", 1), append_log.FileWritten(None, 0)])
    assert [r[0] for r in spark.read.text(path).select("value").collect()] == ["x"]
    assert not os.listdir(f"{path}/_staging")
    w = append_log.AppendWriter(path, "b", ".txt", None)
    os.makedirs(w.staging)
    w.abort([])
    assert not os.path.exists(w.staging)


def test_odd_values_empty_tables_and_names(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    odd = ['a,b', 'q"uote', "back\\slash", "é 日", "", None, " x "]
    sinks.append_metrics_csv(spark.createDataFrame([(m, 1.0) for m in odd], "model string, accuracy double"), path, append_id="odd")
    sinks.append_metrics_csv(spark.createDataFrame([], "model string, accuracy double"), path, append_id="none")
    assert len(glob.glob(f"{path}/append=*")) == 2
    got = [r["model"] for r in readers.scan_metrics_log(spark, path).collect()]
    plain = os.path.join(tmp_dir, "plain")
    sinks.append_metrics_csv(spark.createDataFrame([(m, 1.0) for m in odd], "model string, accuracy double"), plain)
    assert sorted(map(str, got)) == sorted(str(r["model"]) for r in readers.scan_metrics_log(spark, plain).collect())
    with pytest.raises(Exception, match="line break"):
        sinks.append_metrics_csv(spark.createDataFrame([("a\nb", 1.0)], "model string, accuracy double"), path, append_id="broken")
    for bad in ("a/b", "", "a b"):
        with pytest.raises(Exception, match="identifier"):
            sinks.append_metrics_csv(metrics(spark, 1), path, append_id=bad)
    with pytest.raises(ValueError):
        sinks.append_metrics_csv(metrics(spark, 1), path, partition_by="model", append_id="p")


@pytest.mark.parametrize("layout,names", [("board", readers.BOARD_RUN_TABLE_COLUMNS), ("laptop", readers.LAPTOP_RUN_TABLE_COLUMNS)])
def test_run_tables_keep_every_column(spark, tmp_dir, layout, names):
    numbers = {"Duration_ns": "bigint", "Timestamp_Start": "timestamp_ntz"}
    doubles = [n for n in names if n.endswith(("_J", "_s", "_Pct", "MSE", "_score"))]
    cols = [F.lit("2024-01-02 03:04:05.000006").cast("timestamp_ntz").alias(n) if n == "Timestamp_Start"
            else F.lit(10**15).cast("bigint").alias(n) if n == "Duration_ns"
            else (F.col("id") + F.lit(i / 8)).alias(n) if n in doubles else F.concat(F.lit(f"{n} "), "id").alias(n) for i, n in enumerate(names)]
    df = spark.range(5).select(*cols)
    df = df.withColumn("Timestamp_Start", F.when(F.col("__run_id") != "__run_id 3", F.col("Timestamp_Start")))
    path = os.path.join(tmp_dir, "table")
    for part in (df.where("__run_id < '__run_id 2'"), df.where("__run_id >= '__run_id 2'"), df.where("__run_id >= '__run_id 2'")):
        sinks.append_run_table(part, path, f"upto-{'2' if '<' in str(part) else part.count()}", layout)
    back = readers.scan_run_table(spark, path, layout)
    assert back.columns == names and numbers.keys() >= {"Timestamp_Start"}
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.select(*names).collect()), key=str)
    assert any("FAILED" in open(f).read() for f in glob.glob(f"{path}/append=*/*.csv"))
