"""Source and sink keys as round trips of the driver's tables.

Each call writes a projection of a driver table with the sink under test into
a fresh folder of the shared checkpoint area and returns the reader's view of
it; the oracle is the same projection computed by DuckDB from the parquet
table, so the check covers both directions.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from wattframe.functions import scalars as S
from wattframe.operators import runs
from wattframe.plans import standins as SI
from wattframe.plans.catalog import query
from wattframe.plans.common import rounded
from wattframe.plans.q_runs import (_DESIGN_SQL, _LOGS_SQL, BOARD_RUN_TABLE_SQL, LAPTOP_RUN_TABLE_SQL, _design, _metrics_layouts,
                                    _metrics_logs, board_run_table, laptop_run_table)
from wattframe.session import scratch_path
from wattframe.sources import power_source, readers, sinks
from wattframe.streaming import meter

_TS_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@query("scan_csv_header", oracle="""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_shipdate FROM lineitem""")
def scan_csv_header(spark, sf_dir):
    path = scratch_path(spark, "csv_header")
    li = SI.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                                    "l_returnflag", "l_shipdate")
    li.write.option("header", True).option("timestampNTZFormat", _TS_FMT).csv(path)
    schema = ("l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
              "l_returnflag string, l_shipdate timestamp_ntz")
    return readers.scan_csv_header(spark, path, schema)


@query("scan_csv_headerless", oracle="""
SELECT ts AS Date, value / 500.0 AS CPU_Utilization, value + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS Total_P,
       value AS CPU_P, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS GPU_P FROM events""")
def scan_csv_headerless(spark, sf_dir):
    path = scratch_path(spark, "csv_headerless")
    s = SI.power_samples(spark, sf_dir)
    s.select(F.col("ts").alias("Date"), (F.col("cpu_w") / F.lit(500.0)).alias("CPU_Utilization"),
             (F.col("cpu_w") + F.col("gpu_w")).alias("Total_P"), F.col("cpu_w").alias("CPU_P"),
             F.col("gpu_w").alias("GPU_P")).write.option("timestampNTZFormat", _TS_FMT).csv(path)
    return readers.scan_csv_headerless(spark, path, readers.headerless_power_schema())


_SUPERSET_SQL = """
SELECT {ts} AS timestamp, model, CAST(NULL AS DOUBLE) AS r2_score, CAST(NULL AS DOUBLE) AS MSE,
       CAST(NULL AS DOUBLE) AS RMSE, CAST(NULL AS DOUBLE) AS MAE, accuracy, precision, recall, f1,
       num_classes, CAST(NULL AS INTEGER) AS random_seed, CAST(NULL AS DOUBLE) AS test_size,
       CAST(NULL AS INTEGER) AS epochs, CAST(NULL AS INTEGER) AS batch_size
FROM logs"""


def _append_round_trip(spark, sf_dir, fmt):
    path = scratch_path(spark, f"metrics_{fmt}")
    logs = _metrics_logs(spark, sf_dir)
    a_types = ["click", "view", "signup"]
    write = sinks.append_metrics_csv if fmt == "csv" else sinks.append_metrics_json
    write(logs.where(F.col("model").isin(a_types)), path, append_id="first")       # first layout
    write(logs.where(~F.col("model").isin(a_types)), path, append_id="second")     # second layout, appended
    write(logs.where(~F.col("model").isin(a_types)), path, append_id="second")     # and again: nothing is added
    return readers.scan_metrics_log(spark, path, fmt)


@query("append_metrics_csv", oracle="WITH " + _LOGS_SQL + _SUPERSET_SQL.format(ts="date_trunc('second', timestamp)"))
def append_metrics_csv(spark, sf_dir):
    return _append_round_trip(spark, sf_dir, "csv")


@query("append_metrics_json", oracle="WITH " + _LOGS_SQL + _SUPERSET_SQL.format(ts="date_trunc('second', timestamp)"))
def append_metrics_json(spark, sf_dir):
    return _append_round_trip(spark, sf_dir, "json")


@query("scan_json_records", oracle="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def scan_json_records(spark, sf_dir):
    """Each part file one JSON array of records, times included."""
    path = scratch_path(spark, "json_records")
    orders = SI.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    sinks.write_json_array(orders, path)
    return readers.scan_json_records(spark, path, orders.schema)


@query("write_run_table", oracle=BOARD_RUN_TABLE_SQL)
def write_run_table(spark, sf_dir):
    """All columns of the board's run table, appended in two batches of runs, the second
    one twice under its identifier, and read back."""
    path = scratch_path(spark, "run_table")
    table = board_run_table(spark, sf_dir)
    odd = F.crc32(F.col("__run_id").cast("binary")) % 2 == 1
    for part, name in ((table.where(odd), "odd"), (table.where(~odd), "even"), (table.where(~odd), "even")):
        sinks.append_run_table(part, path, name)
    return rounded(readers.scan_run_table(spark, path, "board"), {"CPU_Energy_J": 2})


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


_POWER_LOGS_SQL = f"""
WITH s AS (SELECT user_id, ts, value, {_K} AS k FROM events)
SELECT CAST(user_id AS {{kind}}) AS run, CAST(0 AS {{kind}}) AS rep, CAST(NULL AS {{kind}}) AS pid, 'system' AS layout,
       date_trunc('millisecond', ts) AS ts, value / 500.0 AS cpu_util, value + k AS total_w, value AS cpu_w,
       k AS gpu_w FROM s
UNION ALL
SELECT user_id, 0, 100000 + user_id, 'process', date_trunc('millisecond', ts),
       value / 500.0, CAST(NULL AS DOUBLE), value, CAST(NULL AS DOUBLE) FROM s"""


def _written_power_logs(spark, sf_dir):
    """Both meter layouts written per run, a folder per log name."""
    root = scratch_path(spark, "power_logs")
    s = SI.power_samples(spark, sf_dir)
    run = F.col("run_id").cast("string")
    date = S.power_time_text("ts").alias("Date")
    util = (F.col("cpu_w") / F.lit(500.0)).alias("CPU Utilization")
    system = s.select(F.concat(F.lit("run_"), run, F.lit("_repetition_0.csv")).alias("log"), date, util,
                      (F.col("cpu_w") + F.col("gpu_w")).alias("Total Power"), F.col("cpu_w").alias("CPU Power"),
                      F.col("gpu_w").alias("GPU Power"))
    process = s.select(F.concat(F.lit("run_"), run, F.lit("_repetition_0.csv-"),
                                (F.col("run_id") + F.lit(100000)).cast("string"), F.lit(".csv")).alias("log"),
                       date, util, F.col("cpu_w").alias("CPU Power"))
    for part in (system, process):
        power_source.write_logs(part, root)
    return root


@query("scan_power_logs", oracle=_POWER_LOGS_SQL.format(kind="INTEGER"))
def scan_power_logs(spark, sf_dir):
    """Both layouts read back as one table."""
    out = readers.scan_power_logs(spark, _written_power_logs(spark, sf_dir), system_glob="log=run_*_repetition_*.csv/*.csv",
                                  process_glob="log=run_*_repetition_*.csv-*.csv/*.csv")
    # the table's types: the process of a log is a number beyond its run's
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("run", "pid")}).drop("file")


@query("scan_power_log_source", oracle=_POWER_LOGS_SQL.format(kind="BIGINT"))
def scan_power_log_source(spark, sf_dir):
    """The same logs through the data source."""
    return power_source.scan(spark, _written_power_logs(spark, sf_dir)).drop("file")


@query("stream_power_logs", oracle=_POWER_LOGS_SQL.format(kind="BIGINT"))
def stream_power_logs(spark, sf_dir):
    """The same logs through the data source as a stream, written batch by batch."""
    root, sink, ckpt = _written_power_logs(spark, sf_dir), scratch_path(spark, "power_stream"), scratch_path(spark, "power_stream_ckpt")
    meter.start_to_folder(power_source.follow(spark, root).drop("file"), sink, ckpt, "stream_power_logs", mode="append")
    return spark.read.parquet(sink).drop("batch_id")


@query("scan_metrics_log", oracle="WITH " + _LOGS_SQL + _SUPERSET_SQL.format(ts="timestamp"))
def scan_metrics_log(spark, sf_dir):
    """Each layout written as its own CSV log, each read back into the superset schema."""
    root = scratch_path(spark, "metrics_logs")
    parts = []
    for i, log in enumerate(_metrics_layouts(spark, sf_dir)):
        path = os.path.join(root, f"log_{i}")
        log.write.option("header", True).option("timestampNTZFormat", _TS_FMT).csv(path)
        parts.append(readers.scan_metrics_log(spark, path))
    return parts[0].unionByName(parts[1])


@query("scan_run_table", oracle=BOARD_RUN_TABLE_SQL)
def scan_run_table(spark, sf_dir):
    """Board-layout run table as the runner writes it (text FAILED for a missing start),
    with all its metrics, read back typed."""
    path = scratch_path(spark, "board_run_table")
    board = board_run_table(spark, sf_dir)
    start = F.coalesce(F.date_format("Timestamp_Start", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("FAILED"))
    sinks.write_run_table(board.withColumn("Timestamp_Start", start), path)
    return rounded(readers.scan_run_table(spark, path, "board"), {"CPU_Energy_J": 2})


@query("scan_laptop_run_table", oracle=LAPTOP_RUN_TABLE_SQL)
def scan_laptop_run_table(spark, sf_dir):
    """All columns of the laptop's run table, appended and read back."""
    path = scratch_path(spark, "laptop_run_table")
    sinks.append_run_table(laptop_run_table(spark, sf_dir), path, "all", "laptop")
    back = readers.scan_run_table(spark, path, "laptop")
    for j in ("Total_Energy_J", "CPU_Energy_J", "GPU_Energy_J"):
        back = back.withColumn(j, F.col(j).cast("bigint"))
    return back


@query("scan_run_order", oracle=_DESIGN_SQL + """,
h AS (SELECT *, ('0x' || substr(md5('42:' || run_id), 1, 8))::BIGINT AS order_key FROM design)
SELECT CAST(row_number() OVER (ORDER BY order_key, run_id) - 1 AS BIGINT) AS pos, run_id AS ml_library FROM h""")
def scan_run_order(spark, sf_dir):
    """The shuffled run order written as a sorted one-column list, read back with positions."""
    path = scratch_path(spark, "run_order")
    order = runs.shuffle_design(_design(spark, sf_dir)).orderBy("position")
    order.select(F.col("run_id").alias("ml_library")).write.option("header", True).csv(path)
    return readers.scan_run_order(spark, path, "ml_library")
