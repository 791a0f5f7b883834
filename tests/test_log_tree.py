"""Folders of logs listed and read by tasks: the same rows as Spark's own reader, nothing per log on the driver."""

import os
import random

import pytest

from wattframe.sources import readers
from wattframe.sources.log_tree import LogTree

SYSTEM = "Date,CPU Utilization,Total Power,CPU Power,GPU Power\n"
PROCESS = "Date,CPU Utilization,CPU Power\n"
SYSTEM_GLOB, PROCESS_GLOB = "log=run_*_repetition_*.csv/*.csv", "log=run_*_repetition_*.csv-*.csv/*.csv"


def write(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)


def scan(spark, folder):
    return readers.scan_power_logs(spark, folder, system_glob=SYSTEM_GLOB, process_glob=PROCESS_GLOB)


def layouts():
    return {SYSTEM_GLOB: (readers.SYSTEM_LOG_COLUMNS, readers._SYSTEM_NAME), PROCESS_GLOB: (readers.PROCESS_LOG_COLUMNS, "")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_driver_holds_no_entry_per_log(spark, tmp_dir):
    for run in range(30):
        write(tmp_dir, f"log=run_{run}_repetition_0.csv/part-0.csv", SYSTEM + f"2024-1-5 0:00:0{run % 10}.{run},0.5,{run}.5,2.0,1.0\n")
        write(tmp_dir, f"log=run_{run}_repetition_0.csv-{100 + run}.csv/part-0.csv", PROCESS + f"2024-1-5 0:00:0{run % 10}.{run},0.5,2.0\n")
    df = scan(spark, tmp_dir)
    assert not df.inputFiles()
    assert "InMemoryFileIndex" not in df._jdf.queryExecution().toString()
    want = [(r, None if p else r + 0.5, 100 + r if p else None) for r in range(30) for p in (0, 1)]
    assert rows(df.select("run", "total_w", "pid")) == sorted(want, key=str)


ODD = [
    "", SYSTEM, SYSTEM[:-1], "\n \n\t\n" + SYSTEM + "a,b,c,d,e\n\n  \nf,g,h,i,j", SYSTEM + "a\nb,\nc,,,,\nd,e,f,g,h,i,j\n",
    SYSTEM + '"a,b",c,"d ""e""",f,g\n" x ", y ,"","z\n1,2"\n\\",\\,a"b,"c\n', SYSTEM.replace("\n", "\r\n") + "a,b,c,d,e\r\n\r\nf,g,h,i,j\r\n",
    SYSTEM.replace("\n", "\r") + "a,b,c,d,e\rf,g,h,i,j", b"\xef\xbb\xbf" + SYSTEM.encode() + b"a,b\xff\xfe,\xc3\xa9,d,e\n\xef\xbb\xbfx,y\n",
    SYSTEM + "#a,b,c,d,e\n\x0b\x0c\x1c\nx\x0by\x85, z,c\n", SYSTEM + "".join(f"{i},{'x' * (i % 17)},{i},,\n" for i in range(400)),
]


def test_odd_files_as_spark_reads_them(spark, tmp_dir):
    root = os.path.join(tmp_dir, "a b%20cé#x")
    for i, data in enumerate(ODD):
        write(root, f"log=run_{i}_repetition_0.csv/part-0.csv", data)
        write(root, f"log=run_{i}_repetition_0.csv-7.csv/part +{i}.csv", data)
    for hidden in ("log=run_1_repetition_1.csv/_part.csv", "log=run_1_repetition_1.csv/.part.csv", "log=run_1_repetition_1.csv/part.txt",
                   "_log/log=run_2_repetition_1.csv/part.csv", ".log/log=run_2_repetition_1.csv/part.csv", "log=run_3_repetition_1.csv",
                   "other=run_3_repetition_1.csv/part.csv", "log=run_4_repetition_1.csv/deeper/part.csv",
                   "log=run_6_repetition_1.csv/_metadata.csv"):
        write(root, hidden, ODD[3])
    for seen in ("deeper/log=run_5_repetition_1.csv/part.csv", "log=run_6_repetition_1.csv/_part=1.csv", "_metadata/log=run_7_repetition_1.csv/part.csv",
                 "log=run_x_repetition_1.csv-8.csv/part.csv"):
        write(root, seen, ODD[3])
    want = readers._scan_folders_listed(spark, root, layouts())
    got = readers._scan_folders(spark, root, layouts())
    for glob in layouts():
        assert got[glob].columns == want[glob].columns
        assert rows(got[glob]) == rows(want[glob])
        assert len(rows(got[glob])) > 400


def test_every_line_once_in_any_ranges(spark, tmp_dir):
    rng = random.Random(3)
    for run in range(6):
        end = "\r\n" if run % 2 else "\n"
        lines = [f"{run},{i},{'x' * rng.randrange(30)},," for i in range(rng.randrange(60))]
        write(tmp_dir, f"log=run_{run}_repetition_0.csv/part-0.csv", SYSTEM.replace("\n", end) + end.join(lines) + end * rng.randrange(2))
    names, pattern = layouts()[SYSTEM_GLOB]
    want = rows(readers._scan_folders_listed(spark, tmp_dir, {SYSTEM_GLOB: (names, pattern)})[SYSTEM_GLOB])
    for range_bytes in (1 << 20, 300, 61):
        tree = LogTree(spark, tmp_dir, [SYSTEM_GLOB], [pattern], range_bytes)
        assert rows(tree.csv(0, names)) == want
        assert tree.pieces.where("start > 0").count() > 0 or range_bytes == 1 << 20


def test_folders_without_logs(spark, tmp_dir):
    for folder in (tmp_dir, os.path.join(tmp_dir, "missing")):
        with pytest.raises(FileNotFoundError, match="no power logs"):
            scan(spark, folder)
    os.makedirs(os.path.join(tmp_dir, "log=run_1_repetition_0.csv"))  # a log without a part
    assert scan(spark, tmp_dir).count() == 0
    write(tmp_dir, "log=run_1_repetition_0.csv/part-0.csv", SYSTEM + "2024-1-5 0:14:47.10,0.5,3.0,2.0,1.0\n")
    assert rows(scan(spark, tmp_dir).select("run", "layout", "total_w")) == [(1, "system", 3.0)]


def test_a_store_that_arrow_does_not_know(spark, tmp_dir):
    write(tmp_dir, "log=run_1_repetition_0.csv/part-0.csv", SYSTEM + "2024-1-5 0:14:47.10,0.5,3.0,2.0,1.0\n")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.logs.link./in", f"file://{tmp_dir}")
    assert rows(scan(spark, "viewfs://logs/in").select("run", "layout", "total_w")) == [(1, "system", 3.0)]
