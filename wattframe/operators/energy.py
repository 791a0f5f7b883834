"""Power samples -> steps -> energy per run.

A run's samples are ordered by (ts, tie-break).  The step of a sample is the
time since the previous sample of the same run; the first sample of a run has
no predecessor and gets the mean of the other steps.  Energy is
``sum(power * step)``, which has the closed form

    E = sum_{i>=2} P_i * dt_i  +  P_1 * (t_last - t_first) / (n - 1)

and is 0.0 for a run with one sample.

Scale: a window partitioned by run alone would put a whole run into one task,
and a single run may hold a large share of all samples.  The samples are dealt
out by range of (run, time, tie-break) instead, so a chunk is what one range
partition holds of a run: about as many samples as any other, whether the run is
sparse or has all its samples in one hour.  A range partition is sorted and read once,
each step from the sample before: the samples are shuffled once.  The only cross-chunk information a sample needs is
the last timestamp of the run's previous chunk; that comes from a chunk-edge
table with one row per run and range partition that it touches, and a window
over those rows.  With ``chunk_seconds`` fixed time slices are used as chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.functions.scalars import epoch_micros
from wattframe.operators.ranking import by_range

DEFAULT_CHUNK_SECONDS = None  # by range partitions


def _micros(ts_col: str) -> Column:
    return epoch_micros(ts_col)


def _with_chunks(samples: DataFrame, run_cols: Sequence[str], ts_col: str, order_cols: Sequence[str],
                 chunk_seconds: int | None, freeze: bool) -> DataFrame:
    rows = samples.withColumn("_us", _micros(ts_col))
    if chunk_seconds is not None:
        chunk_us = int(chunk_seconds) * 1_000_000
        return rows.withColumn("_chunk", F.floor(F.col("_us") / F.lit(chunk_us)).cast("long"))
    return by_range(rows, [*run_cols, "_us", *order_cols], out="_chunk", freeze=freeze)


def _chunk_table(rows: DataFrame, run_cols: Sequence[str], power_cols: Sequence[str],
                 order_cols: Sequence[str], ts_col: str) -> DataFrame:
    """One row per (run, chunk): counts, in-chunk energy sums, first/last sample."""
    keys = [*run_cols, "_chunk"]
    order_struct = F.struct(F.col("_us"), *[F.col(c) for c in order_cols])
    aggs = [
        F.count(F.lit(1)).alias("_n"),
        F.min("_us").alias("_first_us"),
        F.max("_us").alias("_last_us"),
        F.min(ts_col).alias("_first_ts"),
    ]
    for p in power_cols:
        aggs.append(F.sum(F.col(p) * F.col("_dt_in")).alias(f"_s_{p}"))
        aggs.append(F.min_by(F.col(p), order_struct).alias(f"_p1_{p}"))
    chunks = rows.groupBy(*keys).agg(*aggs)
    w_run = Window.partitionBy(*run_cols).orderBy("_chunk")
    return chunks.withColumn("_prev_last_us", F.lag("_last_us").over(w_run))


def _in_chunk_steps(samples: DataFrame, run_cols: Sequence[str], ts_col: str,
                    order_cols: Sequence[str], chunk_seconds: int | None, freeze: bool) -> DataFrame:
    """Add ``_us``, ``_chunk``, ``_dt_in`` (step within the chunk) and ``_first`` (of its
    chunk).  Range partitions are sorted and scanned in place; only fixed time slices
    are shuffled a second time, by (run, slice)."""
    rows = _with_chunks(samples, run_cols, ts_col, order_cols, chunk_seconds, freeze)
    if chunk_seconds is None:
        return sorted_steps(rows, run_cols, order_cols)
    w = Window.partitionBy(*run_cols, "_chunk").orderBy(F.col(ts_col), *[F.col(c) for c in order_cols])
    return (rows.withColumn("_dt_in", (F.col("_us") - F.lag("_us").over(w)) / F.lit(1e6))
            .withColumn("_first", F.row_number().over(w) == 1))


def sorted_steps(rows: DataFrame, run_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Add ``_dt_in`` and ``_first`` to range partitions of (run, ``_us``, order): each is
    sorted and read once, the last sample of a batch carried into the next."""
    run_cols = list(run_cols)
    schema = T.StructType(rows.schema.fields).add("_dt_in", "double").add("_first", "boolean")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # one row more in front: the last of the batch before
            head = batch.slice(0, 1) if last is None else last
            both = pa.Table.from_batches([head, batch]).combine_chunks()
            new = pa.array([last is None] + [False] * (batch.num_rows - 1), pa.bool_())
            for c in run_cols:
                now, before = both[c].slice(1), both[c].slice(0, batch.num_rows)
                differ = pc.fill_null(pc.not_equal(now, before), False)
                new = pc.or_(new, pc.or_(differ, pc.xor(pc.is_null(now), pc.is_null(before))))
            new = new.combine_chunks() if isinstance(new, pa.ChunkedArray) else new
            us = both["_us"]
            step = pc.divide(pc.cast(pc.subtract(us.slice(1), us.slice(0, batch.num_rows)), pa.float64()), 1e6)
            step = pc.if_else(new, pa.scalar(None, pa.float64()), step)
            step = step.combine_chunks() if isinstance(step, pa.ChunkedArray) else step
            yield pa.RecordBatch.from_arrays([*batch.columns, step, new], names=schema.names)
            last = batch.slice(batch.num_rows - 1)

    return rows.sortWithinPartitions(*run_cols, "_us", *order_cols).mapInArrow(scan, schema)


def sample_deltas(samples: DataFrame, run_cols: Sequence[str], ts_col: str = "ts",
                  order_cols: Sequence[str] = (), power_cols: Sequence[str] = (),
                  chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Per-sample step in seconds.

    Adds ``dt_s`` (NULL for the first sample of a run, like ``diff()``) and
    ``dt_fill_s`` (first step := mean of the run's other steps; NULL for a
    one-sample run).
    """
    run_cols, order_cols = list(run_cols), list(order_cols)
    rows = _in_chunk_steps(samples, run_cols, ts_col, order_cols, chunk_seconds, freeze=True)  # read three times below
    chunks = _chunk_table(rows, run_cols, power_cols, order_cols, ts_col)
    runs = chunks.groupBy(*run_cols).agg(
        F.sum("_n").alias("_run_n"),
        ((F.max("_last_us") - F.min("_first_us")) / F.lit(1e6)).alias("_span"),
    )
    edge = _edges(chunks, runs, run_cols)
    # only the first sample of a chunk needs what lies outside of it
    rest = rows.where(~F.col("_first")).withColumn("dt_s", F.col("_dt_in")).withColumn("dt_fill_s", F.col("_dt_in"))
    on = F.col("_chunk") == F.col("_ec")
    for i, c in enumerate(run_cols):
        on = on & F.col(c).eqNullSafe(F.col(f"_e{i}"))
    firsts = rows.where("_first").join(edge, on, "left")
    firsts = firsts.withColumn("dt_s", (F.col("_us") - F.col("_prev_last_us")) / F.lit(1e6))
    firsts = firsts.withColumn("dt_fill_s", F.coalesce("dt_s", "_mean_dt"))
    kept = [*samples.columns, "dt_s", "dt_fill_s"]
    return rest.select(*kept).unionByName(firsts.select(*kept))


def _edges(chunks: DataFrame, runs: DataFrame, run_cols: Sequence[str]) -> DataFrame:
    """Per (run, chunk): the last time before it and the run's mean step."""
    right = runs.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(run_cols)], "_run_n", "_span")
    on = F.lit(True)
    for i, c in enumerate(run_cols):
        on = on & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    mean = F.when(F.col("_run_n") > 1, F.col("_span") / (F.col("_run_n") - 1))
    return chunks.join(right, on).select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(run_cols)], F.col("_chunk").alias("_ec"),
                                         "_prev_last_us", mean.alias("_mean_dt"))


def energy_per_run(samples: DataFrame, run_cols: Sequence[str], power_cols: Sequence[str],
                   ts_col: str = "ts", order_cols: Sequence[str] = (),
                   chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Energy in joules per run for each power column (closed form, chunked).

    Output: run keys, ``n_samples``, ``start_ts``, ``span_s``, ``mean_dt_s`` and
    ``<power>_energy_j`` for every power column.
    """
    run_cols, order_cols, power_cols = list(run_cols), list(order_cols), list(power_cols)
    needed = list(dict.fromkeys([*run_cols, ts_col, *order_cols, *power_cols]))
    rows = _in_chunk_steps(samples.select(*needed), run_cols, ts_col, order_cols, chunk_seconds, freeze=False)
    chunks = _chunk_table(rows, run_cols, power_cols, order_cols, ts_col)
    edge_dt = (F.col("_first_us") - F.col("_prev_last_us")) / F.lit(1e6)
    aggs = [
        F.sum("_n").alias("n_samples"),
        F.min("_first_us").alias("_t0"),
        F.max("_last_us").alias("_t1"),
        F.min("_first_ts").alias("start_ts"),
    ]
    for p in power_cols:
        aggs.append((F.coalesce(F.sum(f"_s_{p}"), F.lit(0.0))
                     + F.coalesce(F.sum(F.col(f"_p1_{p}") * edge_dt), F.lit(0.0))).alias(f"_body_{p}"))
        aggs.append(F.min_by(F.col(f"_p1_{p}"), F.col("_chunk")).alias(f"_first_{p}"))
    runs = chunks.groupBy(*run_cols).agg(*aggs)
    span = (F.col("_t1") - F.col("_t0")) / F.lit(1e6)
    mean_dt = F.when(F.col("n_samples") > 1, span / (F.col("n_samples") - 1))
    out = (runs.withColumn("span_s", span)
           .withColumn("mean_dt_s", mean_dt))
    for p in power_cols:
        # a missing first power is skipped, as a NaN-skipping sum does
        first_term = F.coalesce(F.col(f"_first_{p}") * F.col("mean_dt_s"), F.lit(0.0))
        energy = F.when(F.col("n_samples") > 1, F.col(f"_body_{p}") + first_term).otherwise(F.lit(0.0))
        out = out.withColumn(f"{p}_energy_j", energy)
    keep = [*run_cols, "n_samples", "start_ts", "span_s", "mean_dt_s", *[f"{p}_energy_j" for p in power_cols]]
    return out.select(*keep)


def first_sample(samples: DataFrame, run_cols: Sequence[str], value_cols: Sequence[str],
                 ts_col: str = "ts", order_cols: Sequence[str] = ()) -> DataFrame:
    """Start time of each run and the values of its first sample (``iloc[0]``).

    A plain aggregate: partial aggregation runs map-side, so a hot run costs
    one small buffer per task rather than one task.
    """
    order = F.struct(F.col(ts_col), *[F.col(c) for c in order_cols])
    return samples.groupBy(*run_cols).agg(
        F.min(ts_col).alias("start_ts"),
        *[F.min_by(F.col(c), order).alias(f"first_{c}") for c in value_cols],
    )


def energy_constant_step(samples: DataFrame, runs: DataFrame, run_cols: Sequence[str],
                         seconds_col: str, cpu_col: str, gpu_col: str) -> DataFrame:
    """Energy as power sample x run seconds (laptop form), total = CPU + GPU.

    sum(P_i * secs) = secs * sum(P_i): power is summed per run first (a partial
    aggregate, so a run with many samples never meets its run row in one task),
    then the one-row-per-run sums are joined to ``runs`` (one row per run)."""
    run_cols = list(run_cols)
    sums = samples.groupBy(*run_cols).agg(F.sum(cpu_col).alias("_cpu"), F.sum(gpu_col).alias("_gpu"))
    joined = sums.join(runs.select(*run_cols, seconds_col), on=run_cols, how="inner")
    return joined.select(
        *run_cols,
        (F.col("_cpu") * F.col(seconds_col)).alias("cpu_energy_j"),
        (F.col("_gpu") * F.col(seconds_col)).alias("gpu_energy_j"),
    ).withColumn("total_energy_j", F.col("cpu_energy_j") + F.col("gpu_energy_j"))
