"""Power samples -> steps -> energy -> board summary (the flagship slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.functions import scalars as S
from wattframe.operators import clean, energy, summary
from wattframe.plans import standins as SI
from wattframe.plans.catalog import query
from wattframe.plans.common import rounded

_SAMPLES_SQL = """
  SELECT user_id AS run_id, event_id AS seq, ts, value AS cpu_w,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS gpu_w, event_type
  FROM events"""

_STEPS_SQL = f"""
WITH s AS ({_SAMPLES_SQL}),
d AS (
  SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run_id ORDER BY ts, seq)) / 1e6 AS dt_s
  FROM s)
SELECT *, coalesce(dt_s, ((epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w)) / 1e6)
                        / nullif(count(*) OVER w - 1, 0)) AS dt_fill_s
FROM d WINDOW w AS (PARTITION BY run_id)"""


@query("sample_delta", oracle=f"""
WITH x AS ({_STEPS_SQL})
SELECT run_id, seq, ts, round(dt_s, 6) AS dt_s FROM x""")
def sample_delta(spark, sf_dir):
    s = SI.power_samples(spark, sf_dir)
    d = energy.sample_deltas(s, ["run_id"], order_cols=["seq"])
    return rounded(d.select("run_id", "seq", "ts", "dt_s"), {"dt_s": 6})


@query("first_delta_backfill", oracle=f"""
WITH x AS ({_STEPS_SQL})
SELECT run_id, seq, round(dt_fill_s, 6) AS dt_fill_s FROM x""")
def first_delta_backfill(spark, sf_dir):
    s = SI.power_samples(spark, sf_dir)
    d = energy.sample_deltas(s, ["run_id"], order_cols=["seq"])
    return rounded(d.select("run_id", "seq", "dt_fill_s"), {"dt_fill_s": 6})


@query("energy_integral", oracle=f"""
WITH x AS ({_STEPS_SQL})
SELECT run_id, count(*) AS n_samples, min(ts) AS start_ts,
       round(coalesce(sum(cpu_w * dt_fill_s), 0), 2) AS cpu_w_energy_j,
       round(coalesce(sum(gpu_w * dt_fill_s), 0), 2) AS gpu_w_energy_j
FROM x GROUP BY run_id""")
def energy_integral(spark, sf_dir):
    s = SI.power_samples(spark, sf_dir)
    e = energy.energy_per_run(s, ["run_id"], ["cpu_w", "gpu_w"], order_cols=["seq"])
    return rounded(e.select("run_id", "n_samples", "start_ts", "cpu_w_energy_j", "gpu_w_energy_j"),
                   {"cpu_w_energy_j": 2, "gpu_w_energy_j": 2})


@query("first_sample_time", oracle=f"""
WITH s AS ({_SAMPLES_SQL})
SELECT run_id, min(ts) AS start_ts, arg_min(cpu_w, (ts, seq)) AS first_cpu_w
FROM s GROUP BY run_id""")
def first_sample_time(spark, sf_dir):
    s = SI.power_samples(spark, sf_dir)
    return energy.first_sample(s, ["run_id"], ["cpu_w"], order_cols=["seq"])


@query("energy_constant_step", oracle=f"""
WITH s AS ({_SAMPLES_SQL}),
r AS (SELECT run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS run_s FROM s GROUP BY run_id)
SELECT run_id, round(sum(cpu_w * run_s), 0) AS cpu_energy_j, round(sum(gpu_w * run_s), 0) AS gpu_energy_j,
       round(sum(cpu_w * run_s) + sum(gpu_w * run_s), 0) AS total_energy_j
FROM s JOIN r USING (run_id) GROUP BY run_id""")
def energy_constant_step(spark, sf_dir):
    s = SI.power_samples(spark, sf_dir)
    runs = s.groupBy("run_id").agg(
        S.interval_seconds(F.min("ts"), F.max("ts")).alias("run_s"))
    e = energy.energy_constant_step(s, runs, ["run_id"], "run_s", "cpu_w", "gpu_w")
    # values reach ~1e10 J (a month of seconds x summed watts): whole joules keep
    # the comparison clear of summation-order noise (relative 1e-10)
    return rounded(e, {"cpu_energy_j": 0, "gpu_energy_j": 0, "total_energy_j": 0})


# Flagship: runs are (event_type, user) pairs - event type plays the library,
# the user the repetition.  Energy per run -> board metrics -> summary per library.
BOARD_ENERGY_SQL = f"""
WITH x AS (
  SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type, run_id ORDER BY ts, seq)) / 1e6 AS dt_s
  FROM ({_SAMPLES_SQL})),
f AS (SELECT *, coalesce(dt_s, avg(dt_s) OVER (PARTITION BY event_type, run_id)) AS dt_fill_s FROM x),
r AS (
  SELECT event_type AS Library_Name, run_id,
         coalesce(sum(cpu_w * dt_fill_s), 0) AS E,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS D
  FROM f GROUP BY event_type, run_id)
SELECT Library_Name, count(*) AS N,
       round(avg(CASE WHEN D > 0 THEN E / D END), 6) AS Mean_M1,
       round(avg(E), 2) AS Mean_M2,
       round(avg(D), 4) AS Mean_M3
FROM r GROUP BY Library_Name"""


def board_energy_summary_df(spark, sf_dir):
    s = SI.power_samples(spark, sf_dir)
    e = energy.energy_per_run(s, ["event_type", "run_id"], ["cpu_w"], order_cols=["seq"])
    runs = e.select(F.col("event_type").alias("Library_Name"), "run_id",
                    F.col("cpu_w_energy_j").alias("CPU_Energy_J"),
                    (F.col("span_s") * F.lit(1e9)).alias("Duration_ns"))
    m = clean.derive_board_metrics(runs)
    out = summary.summary_one_key(m, "Library_Name", {"M1": "M1_Avg_Power_W", "M2": "M2_Total_Energy_J",
                                                       "M3": "M3_Exec_Time_s"})
    return rounded(out, {"Mean_M1": 6, "Mean_M2": 2, "Mean_M3": 4})


query("board_energy_summary", oracle=BOARD_ENERGY_SQL)(board_energy_summary_df)
