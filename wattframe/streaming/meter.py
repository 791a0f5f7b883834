"""Live power meter as Structured Streaming.

``stream_energy``: running energy per run from a growing directory of power
samples.  Per-run state is (n, first time, first power, last time and sequence
number, energy body, late count); each micro-batch's samples of a run are applied
in the order of (time, sequence number).  A sample that is not after the run's last
one in that order is late: it is not applied and is counted.  A missing power is
left out of the energy, as in the batch form.  The final value per run equals the
batch ``energy_per_run`` if samples arrive in order across micro-batches.  State of
a run that has been idle for ``idle_timeout_ms`` is closed and dropped.

``segments.stream_segments`` is the form for samples that come in any order; its
state grows with what is still open, here it is one row per run.

``stream_power_windows``: mean / max power per run in tumbling event-time
windows with a watermark.

Both write each micro-batch with ``foreachBatch`` into a folder named by the
batch id (overwrite = idempotent when a batch is retried) and keep their
checkpoints under the shared checkpoint area.  ``read_latest`` turns the
update log into the current value per key.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from wattframe.functions.scalars import epoch_micros


#: a run without a sample for a year of event time is closed
IDLE_TIMEOUT_MS = 365 * 24 * 3600 * 1000


def _state_schema(power_cols: Sequence[str]) -> str:
    cols = ["n long", "first_us long", "last_us long", "late long", "last_seq long"]
    for p in power_cols:
        cols += [f"p1_{p} double", f"body_{p} double"]
    return ", ".join(cols)


def _energy_row(run_cols, power_cols, key, n, first_us, last_us, late, p1, body, closed):
    out = {c: [v] for c, v in zip(run_cols, key)}
    out["n_samples"] = [n]
    out["late_samples"] = [late]
    for p in power_cols:
        e = body[p] + p1[p] * ((last_us - first_us) / 1e6) / (n - 1) if n > 1 else 0.0
        out[f"{p}_energy_j"] = [e]
    out["closed"] = [closed]
    return pd.DataFrame(out)


def _energy_state_fn(run_cols: Sequence[str], power_cols: Sequence[str], idle_timeout_ms: int | None = None):
    run_cols, power_cols = list(run_cols), list(power_cols)

    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:  # idle run: emit its final value and free the state
            st = list(state.get)
            p1 = {p: st[5 + 2 * i] for i, p in enumerate(power_cols)}
            body = {p: st[6 + 2 * i] for i, p in enumerate(power_cols)}
            state.remove()
            yield _energy_row(run_cols, power_cols, key, int(st[0]), int(st[1]), int(st[2]), int(st[3]),
                              p1, body, True)
            return
        frames = list(pdfs)
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values(["_us", "_seq"], kind="mergesort")
        if state.exists:
            st = list(state.get)
            n, first_us, last_us, late = int(st[0]), int(st[1]), int(st[2]), int(st[3])
            p1 = {p: st[5 + 2 * i] for i, p in enumerate(power_cols)}
            body = {p: st[6 + 2 * i] for i, p in enumerate(power_cols)}
            last_seq = int(st[4])
        else:
            n, first_us, last_us, late, last_seq = 0, None, None, 0, None
            p1 = {p: None for p in power_cols}
            body = {p: 0.0 for p in power_cols}
        us = pdf["_us"].to_numpy(dtype=np.int64)
        if last_us is not None:
            seq = pdf["_seq"].to_numpy(dtype=np.int64)
            keep = (us > last_us) | ((us == last_us) & (seq > last_seq))
            late += int((~keep).sum())
            pdf, us = pdf[keep], us[keep]
        if len(us):
            if last_us is None:
                first_us = int(us[0])
                for p in power_cols:
                    p1[p] = float(np.nan_to_num(float(pdf[p].iloc[0])))  # a missing first power gives a zero first term
                prev = np.concatenate([[us[0]], us[:-1]])
            else:
                prev = np.concatenate([[last_us], us[:-1]])
            dt = (us - prev) / 1e6
            for p in power_cols:
                body[p] += float(np.nansum(pdf[p].to_numpy(dtype=float) * dt))
            n += len(us)
            last_us, last_seq = int(us[-1]), int(pdf["_seq"].iloc[-1])
        if n == 0:
            return
        state_row = [n, first_us, last_us, late, last_seq]
        for p in power_cols:
            state_row += [p1[p], body[p]]
        state.update(tuple(state_row))
        if idle_timeout_ms is not None:
            # event time of the watermark is the wall-clock time read as UTC (see stream_energy);
            # a run that lags behind the watermark by more than the timeout closes with the next batch
            state.setTimeoutTimestamp(max(last_us // 1000 + int(idle_timeout_ms), state.getCurrentWatermarkMs() + 1))
        yield _energy_row(run_cols, power_cols, key, n, first_us, last_us, late, p1, body, False)

    return fn


def stream_energy(samples: DataFrame, run_cols: Sequence[str], power_cols: Sequence[str],
                  ts_col: str = "ts", seq_col: str | None = None, idle_timeout_ms: int | None = IDLE_TIMEOUT_MS,
                  watermark: str | None = None) -> DataFrame:
    """Streaming DataFrame of running energy per run (update mode).

    After ``idle_timeout_ms`` (None: never) a run that has had no sample for that long (in
    event time, past the watermark) emits a final row with ``closed`` = true
    and its state is dropped; later samples of the same key start a new run.  The
    ``watermark`` (a tenth of the timeout, a day at most) only closes idle runs: a
    sample behind it is applied if it follows its run's last one, else counted as late."""
    run_cols, power_cols = list(run_cols), list(power_cols)
    s = samples.select(*run_cols, *power_cols,
                       epoch_micros(ts_col).alias("_us"),
                       (F.col(seq_col) if seq_col else F.lit(0)).cast("long").alias("_seq"))
    timeout = GroupStateTimeout.NoTimeout
    if idle_timeout_ms is not None:
        watermark = watermark or f"{min(idle_timeout_ms // 10, 24 * 3600 * 1000)} milliseconds"
        s = s.withColumn("_et", F.timestamp_micros("_us")).withWatermark("_et", watermark)
        # Spark drops rows whose watermark column is behind the watermark before the state
        # function sees them.  The grouping gets a column that is marked as such and NULL,
        # so the watermark moves on and no row is dropped.
        delay = s.schema["_et"].metadata
        s = s.withColumn("_et", F.lit(None).cast("timestamp").alias("_et", metadata=delay))
        timeout = GroupStateTimeout.EventTimeTimeout
    types = dict(samples.dtypes)
    out_schema = ", ".join([f"{c} {types[c]}" for c in run_cols] + ["n_samples long", "late_samples long"]
                           + [f"{p}_energy_j double" for p in power_cols] + ["closed boolean"])
    return s.groupBy(*run_cols).applyInPandasWithState(
        _energy_state_fn(run_cols, power_cols, idle_timeout_ms), out_schema, _state_schema(power_cols), "update",
        timeout)


def stream_power_windows(samples: DataFrame, run_cols: Sequence[str], power_col: str, ts_col: str = "ts",
                         window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Streaming DataFrame of per-run tumbling-window mean / max power.  Spark drops
    samples of windows that end behind the ``watermark``: it has to be longer than samples
    may come out of order.  ``start_to_folder`` counts what was dropped."""
    # Watermarks need TIMESTAMP.  The wall-clock sample time is mapped to the UTC
    # instant with the same clock reading (and window starts mapped back), so
    # windows align to calendar boundaries whatever the session time zone.
    s = samples.withColumn("_et", F.timestamp_micros(epoch_micros(ts_col))).withWatermark("_et", watermark)
    g = s.groupBy(F.window("_et", window).alias("w"), *run_cols).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(power_col).alias("mean_w"), F.max(power_col).alias("max_w"))
    start = F.timestamp_add("MICROSECOND", F.unix_micros("w.start"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return g.select(*run_cols, start.alias("window_start"),
                    "n_samples", "mean_w", "max_w")


def start_to_folder(stream: DataFrame, sink_dir: str, checkpoint_dir: str, name: str, write=None, mode: str = "update"):
    """Run the stream over all available input (``availableNow``), writing each
    micro-batch to ``sink_dir/batch_id=<id>`` (idempotent on retry), or with ``write``
    (of the batch and its id; ``KeyedSink.write`` keeps the folder compact).  The query
    returned has ``rows_behind_watermark``, the number of rows that Spark dropped as
    behind the watermark (of an aggregate: of partly aggregated rows)."""
    def write_batch(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))

    q = (stream.writeStream.queryName(name).outputMode(mode).foreachBatch(write or write_batch)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    dropped, done = {}, False
    while not done:  # a query remembers the progress of its last 100 batches
        done = q.awaitTermination(1)
        for p in q.recentProgress:
            dropped[p.batchId] = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
    q.rows_behind_watermark = sum(dropped.values())
    return q


def read_latest(spark: SparkSession, sink_dir: str, key_cols: Sequence[str]) -> DataFrame:
    """Current value per key from the update log: the row of the highest batch id."""
    log = spark.read.parquet(sink_dir)
    vals = [c for c in log.columns if c not in (*key_cols, "batch_id")]
    latest = log.groupBy(*key_cols).agg(F.max_by(F.struct(*vals), F.col("batch_id")).alias("_r"))
    return latest.select(*key_cols, *[F.col(f"_r.{c}").alias(c) for c in vals])
