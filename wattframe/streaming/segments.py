"""Running energy of power samples that arrive in any order.

The energy of a run is the sum of power times the step since the sample before, and
the first sample's power times the mean step. A stretch of a run's samples without a
gap in between is a segment: its first and last sample, their number, the first
powers and the energy of the steps inside. Two segments, one after the other, merge
exactly: the later one's first sample gets the step from the earlier one's last.

State is kept per shard of runs and time bucket (so one run, however busy, is in as many
keys as it has buckets, and many small runs share a key), with ``transformWithStateInPandas``:

- ``open``, the samples of which earlier or later ones may still come, a block of columns
  from each micro-batch;
- ``sealed``, per run a time-ordered list of segments whose samples are given up. When the
  watermark is ``lateness`` past the bucket's end, a timer seals what is open;
- ``late``, per run: a sample inside a sealed segment cannot be applied and is counted; one
  before, after or between sealed segments is applied as a segment of its own.

Each micro-batch emits the runs and buckets that it touched, each as one merged segment;
``run_energy`` merges the buckets of a run. So the order in which samples come does
not matter up to ``lateness``, neither within nor across micro-batches.

A missing power is left out of the energy, a missing first one gives a zero first
term, as in the batch form; samples without a time are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wattframe.functions.scalars import epoch_micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 24 * 3600 * 1000
SHARDS = 64
#: run columns travel as one text; times keep their microseconds in it
_KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass(frozen=True)
class Segment:
    """Samples are ordered by (time in microseconds, sequence number)."""

    first: tuple[int, int]
    last: tuple[int, int]
    n: int
    start_power: tuple[float, ...]
    body: tuple[float, ...]

    @classmethod
    def of(cls, us: np.ndarray, seq: np.ndarray, power: np.ndarray) -> Segment:
        """Of samples in any order; ``power`` has a row per sample, NaN where missing."""
        order = np.lexsort((seq, us))
        us, seq, power = us[order], seq[order], power[order]
        body = np.nansum(power[1:] * (np.diff(us) / 1e6)[:, None], axis=0)
        return cls((int(us[0]), int(seq[0])), (int(us[-1]), int(seq[-1])), len(us), tuple(map(float, np.nan_to_num(power[0]))), tuple(map(float, body)))

    def then(self, later: Segment) -> Segment:
        """This segment and a later one as one segment."""
        step = (later.first[0] - self.last[0]) / 1e6
        body = tuple(a + b + p * step for a, b, p in zip(self.body, later.body, later.start_power))
        return replace(self, last=later.last, n=self.n + later.n, body=body)

    def row(self) -> tuple:
        return (*self.first, *self.last, self.n, *self.start_power, *self.body)

    @classmethod
    def from_row(cls, row: Sequence) -> Segment:
        k = (len(row) - 5) // 2
        return cls((row[0], row[1]), (row[2], row[3]), row[4], tuple(row[5 : 5 + k]), tuple(row[5 + k :]))


def merged(segments: Sequence[Segment]) -> Segment:
    """Segments that do not overlap, given in any order, as one."""
    out, *rest = sorted(segments, key=lambda s: s.first)
    for s in rest:
        out = out.then(s)
    return out


def apart(us: np.ndarray, seq: np.ndarray, sealed: Sequence[Segment]) -> np.ndarray:
    """Per sample the number of sealed segments before it; -1 if it lies inside one.
    ``sealed`` is in order of time."""
    out = np.zeros(len(us), np.int64)
    for i, (u, s) in enumerate(zip(us.tolist(), seq.tolist())):
        lo = sum(x.first <= (u, s) for x in sealed)
        out[i] = -1 if lo and (u, s) <= sealed[lo - 1].last else lo
    return out


def run_segments(run: np.ndarray, us: np.ndarray, seq: np.ndarray, power: np.ndarray) -> pd.DataFrame:
    """``Segment.of`` for the samples of many runs at once: a row per run with its name and
    what ``Segment.row`` has."""
    codes, names = pd.factorize(run)
    order = np.lexsort((seq, us, codes))
    codes, us, seq, power = codes[order], us[order], seq[order], power[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    last = np.append(first[1:], len(codes)) - 1
    steps = power * (np.diff(us, prepend=us[0]) / 1e6)[:, None]
    steps[first] = 0.0
    body = np.add.reduceat(np.where(np.isnan(steps), 0.0, steps), first, axis=0)
    start = np.nan_to_num(power[first])
    k = range(power.shape[1])
    return pd.DataFrame({"run": names, "a_us": us[first], "a_seq": seq[first], "b_us": us[last], "b_seq": seq[last], "n": last - first + 1}
                        | {f"p{i}": start[:, i] for i in k} | {f"body{i}": body[:, i] for i in k})


def _block(frame: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _frame(blocks: Sequence[bytes]) -> pd.DataFrame:
    return pd.concat([pa.ipc.open_stream(b).read_all().to_pandas() for b in blocks], ignore_index=True)


class EnergySegments(StatefulProcessor):
    """Keys: the shard of the run, then the bucket's number; a row has its run's text."""

    def __init__(self, power_cols: Sequence[str], bucket_ms: int, lateness_ms: int):
        self.power_cols, self.bucket_ms, self.lateness_ms = list(power_cols), bucket_ms, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.columns = handle, ["run", "us", "seq", *[f"p{i}" for i in range(len(self.power_cols))]]
        self.open = handle.getListState("open", "block binary")
        self.sealed = handle.getListState("sealed", "block binary")
        self.late = handle.getValueState("late", "counts string")

    def _seal_time(self, key: tuple) -> int:
        return (int(key[-1]) + 1) * self.bucket_ms + self.lateness_ms

    def _rows(self, key: tuple, whole: pd.DataFrame, late: dict[str, int], closed: bool) -> pd.DataFrame:
        """``whole`` has one merged segment per run."""
        out = {"run": whole["run"], "bucket": int(key[-1]), "first_us": whole["a_us"], "last_us": whole["b_us"], "n_samples": whole["n"],
               "late_samples": [late.get(r, 0) for r in whole["run"]]}
        for i, p in enumerate(self.power_cols):
            out |= {f"{p}_first": whole[f"p{i}"], f"{p}_body": whole[f"body{i}"]}
        return pd.DataFrame(out | {"closed": closed})

    def _segments(self, samples: pd.DataFrame) -> pd.DataFrame:
        return run_segments(samples["run"].to_numpy(object), samples["us"].to_numpy(np.int64), samples["seq"].to_numpy(np.int64),
                            samples[self.columns[3:]].to_numpy(float))

    def _open(self) -> list[bytes]:
        return [r[0] for r in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[self.columns].astype({"us": np.int64, "seq": np.int64})
        if self.sealed.exists() or timerValues.getCurrentWatermarkInMs() >= self._seal_time(key):
            yield self._after_sealing(key, new)
            return
        before = self._open()
        if not before:
            self.handle.registerTimer(self._seal_time(key))
        block = _block(new)
        self.open.appendValue((block,))
        if before:  # all samples of the runs that the micro-batch touches
            old = _frame(before)
            new = pd.concat([old[old["run"].isin(new["run"].unique())], new], ignore_index=True)
        yield self._rows(key, self._segments(new), {}, False)

    def _after_sealing(self, key: tuple, new: pd.DataFrame) -> pd.DataFrame:
        """The bucket was sealed: what fits between a run's segments becomes segments of its own."""
        late = json.loads(self.late.get()[0]) if self.late.exists() else {}
        known = _frame([r[0] for r in self.sealed.get()]) if self.sealed.exists() else None
        touched = new["run"].unique()
        rest = known[~known["run"].isin(touched)] if known is not None else None
        mine = {r: g for r, g in known[known["run"].isin(touched)].groupby("run", sort=False)} if known is not None else {}
        kept, whole = [], []
        for run, samples in new.groupby("run", sort=False):
            sealed = [Segment.from_row(r) for r in mine[run].drop(columns="run").itertuples(index=False, name=None)] if run in mine else []
            sealed.sort(key=lambda s: s.first)
            place = apart(samples["us"].to_numpy(), samples["seq"].to_numpy(), sealed)
            if (place < 0).any():
                late[run] = late.get(run, 0) + int((place < 0).sum())
            for i in sorted(set(place.tolist()) - {-1}):
                part = samples[place == i]
                sealed.append(Segment.of(part["us"].to_numpy(), part["seq"].to_numpy(), part[self.columns[3:]].to_numpy(float)))
            kept += [(run, *s.row()) for s in sealed]
            whole.append((run, *merged(sealed).row()))
        k = range(len(self.power_cols))
        names = ["run", "a_us", "a_seq", "b_us", "b_seq", "n", *[f"p{i}" for i in k], *[f"body{i}" for i in k]]
        kept = pd.DataFrame(kept, columns=names)
        self.sealed.put([(_block(kept if rest is None or rest.empty else pd.concat([rest, kept], ignore_index=True)),)])
        if late:
            self.late.update((json.dumps(late),))
        return self._rows(key, pd.DataFrame(whole, columns=names), late, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._open()
        if before:
            segments = self._segments(_frame(before))
            self.sealed.put([(_block(segments),)])
            self.open.clear()
            yield self._rows(key, segments, {}, True)

    def close(self) -> None:
        pass


def stream_segments(samples: DataFrame, run_cols: Sequence[str], power_cols: Sequence[str], ts_col: str = "ts",
                    seq_col: str | None = None, bucket_ms: int = DAY_MS, lateness_ms: int = DAY_MS, shards: int = SHARDS) -> DataFrame:
    """Streaming table of merged segments per run and bucket (update mode). A bucket is
    sealed when the newest sample's time is ``lateness_ms`` past its end. The runs are dealt
    to ``shards``, which have to stay as they are as long as a checkpoint is used; a task
    holds the samples of one shard and bucket at a time."""
    run_cols, power_cols = list(run_cols), list(power_cols)
    run = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(run_cols)]), _KEY_TEXT)
    # columns reach the processor as fields of a named tuple: plain names, whatever they are here
    s = (samples.select(run.alias("run"), *[F.col(p).cast("double").alias(f"p{i}") for i, p in enumerate(power_cols)],
                        epoch_micros(ts_col).alias("us"), F.coalesce((F.col(seq_col) if seq_col else F.lit(0)).cast("long"), F.lit(0)).alias("seq"))
         .where(F.col("us").isNotNull()).withColumn("bucket", F.floor(F.col("us") / (bucket_ms * 1000)).cast("long"))
         .withColumn("shard", F.pmod(F.xxhash64("run"), F.lit(shards))))
    s = s.withColumn("_et", F.timestamp_micros("us")).withWatermark("_et", "0 seconds")
    # Spark would drop rows behind the watermark before the processor can tell late ones
    # from those it can still apply. Its column is NULL here; the watermark moves on.
    s = s.withColumn("_et", F.lit(None).cast("timestamp").alias("_et", metadata=s.schema["_et"].metadata))
    schema = ", ".join(["run string", "bucket long", "first_us long", "last_us long", "n_samples long", "late_samples long"]
                       + [f"`{p}_first` double, `{p}_body` double" for p in power_cols] + ["closed boolean"])
    out = s.groupBy("shard", "bucket").transformWithStateInPandas(EnergySegments(power_cols, bucket_ms, lateness_ms), schema, "Update", "EventTime")
    types = dict(samples.dtypes)
    names = F.from_json("run", ", ".join(f"k{i} {types[c]}" for i, c in enumerate(run_cols)), _KEY_TEXT)
    return out.select(*[names[f"k{i}"].alias(c) for i, c in enumerate(run_cols)], *[F.col(f"`{c}`") for c in out.columns if c != "run"])


def run_energy(segments: DataFrame, run_cols: Sequence[str], power_cols: Sequence[str]) -> DataFrame:
    """Energy per run from the current segment of each of its buckets: run columns,
    ``n_samples``, ``late_samples`` and ``<power>_energy_j``."""
    run_cols = list(run_cols)
    before = F.lag("last_us").over(Window.partitionBy(*run_cols).orderBy("bucket"))
    rows = segments.withColumn("_gap", (F.col("first_us") - before) / F.lit(1e6))
    aggs = [F.sum("n_samples").cast("long").alias("n_samples"), F.sum("late_samples").cast("long").alias("late_samples"),
            ((F.max("last_us") - F.min("first_us")) / F.lit(1e6)).alias("_span")]
    for p in power_cols:
        aggs += [(F.sum(f"{p}_body") + F.coalesce(F.sum(F.col(f"{p}_first") * F.col("_gap")), F.lit(0.0))).alias(f"_body_{p}"),
                 F.min_by(F.col(f"{p}_first"), F.col("bucket")).alias(f"_first_{p}")]
    runs = rows.groupBy(*run_cols).agg(*aggs)
    energy = [F.when(F.col("n_samples") > 1, F.col(f"_body_{p}") + F.col(f"_first_{p}") * F.col("_span") / (F.col("n_samples") - 1))
              .otherwise(F.lit(0.0)).alias(f"{p}_energy_j") for p in power_cols]
    return runs.select(*run_cols, "n_samples", "late_samples", *energy)


def start_with_rocksdb(spark: SparkSession, start):
    """Call ``start`` with RocksDB as the state store, which list state and timers need.
    A query takes the setting over when it starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
