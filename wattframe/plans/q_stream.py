"""Streaming keys: the driver's samples arrive in slices in a growing folder.

The power samples (derived from ``events``) are written once to the shared checkpoint
area, by slices: a slice holds samples of all runs and of the whole time, picked by a
hash, so every file overlaps every other in time. One query reads the files, some to a
micro-batch. How far samples come out of order is taken from the data: the lateness
allowed is the time that a slice spans. The returned DataFrame is the current value per
key read back from the sink; its oracle is the batch SQL of the same quantity.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from wattframe.functions.scalars import epoch_micros
from wattframe.plans import standins as SI
from wattframe.plans.catalog import query
from wattframe.plans.common import rounded
from wattframe.plans.q_energy import _STEPS_SQL
from wattframe.session import scratch_path
from wattframe.streaming import meter, segments
from wattframe.streaming.keyed_sink import KeyedSink


SLICES = 4
FILES_PER_TRIGGER = 64
BUCKET_MS = 7 * segments.DAY_MS
SHARD_ROWS = 100_000


def _run_growing(spark, sf_dir, name, build_stream, key_cols):
    """``build_stream`` gets the stream, the lateness in milliseconds and the number of samples."""
    samples = SI.power_samples(spark, sf_dir)
    base = scratch_path(spark, name)
    staged, sink, ckpt = (os.path.join(base, p) for p in ("staged", "sink", "checkpoint"))
    arrival = F.pmod(F.crc32(F.col("seq").cast("string").cast("binary")), F.lit(SLICES))
    samples.withColumn("slice", arrival).write.partitionBy("slice").parquet(staged)
    arrived = spark.read.parquet(staged)
    span_us, n_samples = arrived.agg(F.max(epoch_micros("ts")) - F.min(epoch_micros("ts")), F.count(F.lit(1))).first()
    span_us = span_us or 0
    files = spark._jvm.org.apache.hadoop.fs.Path(staged)
    n_files = files.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(files).getFileCount()
    stream_in = (spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", min(FILES_PER_TRIGGER, -(-n_files // SLICES)))
                 .parquet(os.path.join(staged, "slice=*")))
    kept = KeyedSink(spark, sink, key_cols)
    done = segments.start_with_rocksdb(spark, lambda: meter.start_to_folder(
        build_stream(stream_in, span_us // 1000 + 1, n_samples), sink, ckpt, name, kept.write))
    if done.rows_behind_watermark:
        raise RuntimeError(f"{name}: {done.rows_behind_watermark} rows came behind the watermark")
    return kept.read()


@query("stream_energy", oracle=f"""
WITH x AS ({_STEPS_SQL})
SELECT run_id, count(*) AS n_samples, CAST(0 AS BIGINT) AS late_samples,
       round(coalesce(sum(cpu_w * dt_fill_s), 0), 2) AS cpu_w_energy_j,
       round(coalesce(sum(gpu_w * dt_fill_s), 0), 2) AS gpu_w_energy_j
FROM x GROUP BY run_id""")
def stream_energy(spark, sf_dir):
    found = _run_growing(spark, sf_dir, "stream_energy",
                         lambda s, late_ms, n: segments.stream_segments(s, ["run_id"], ["cpu_w", "gpu_w"], "ts", "seq", BUCKET_MS, late_ms,
                                                                                    max(segments.SHARDS, -(-n // SHARD_ROWS))),
                         ["run_id", "bucket"])
    return rounded(segments.run_energy(found, ["run_id"], ["cpu_w", "gpu_w"]), {"cpu_w_energy_j": 2, "gpu_w_energy_j": 2})


@query("stream_power_windows", oracle="""
SELECT user_id AS run_id, date_trunc('day', ts) AS window_start, count(*) AS n_samples,
       round(avg(value), 8) AS mean_w, max(value) AS max_w
FROM events GROUP BY user_id, date_trunc('day', ts)""")
def stream_power_windows(spark, sf_dir):
    out = _run_growing(spark, sf_dir, "stream_power_windows",
                       lambda s, late_ms, n: meter.stream_power_windows(s, ["run_id"], "cpu_w", "ts", "1 day", f"{late_ms} milliseconds"),
                       ["run_id", "window_start"])
    return rounded(out.select("run_id", "window_start", "n_samples", "mean_w", "max_w"), {"mean_w": 8})
