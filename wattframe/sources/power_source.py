"""Power logs as one data source, for batch and for streams.

``spark.read.format("wattframe_power_logs").load(folder)`` and ``readStream`` give the
same rows: the text columns of both layouts with run, repetition and process from the
log's name. ``power_samples`` turns them into typed samples; ``scan`` and ``follow``
do both steps.

A read partition carries byte ranges of logs and what their names say. Large logs are
cut into ranges, small ones share a partition. A line belongs to the range in which
it begins, so ranges need not know each other.

``write_logs`` writes rows in the meter's layout, a folder per log: each log by one task
(a very large one by several, a part file each), so the number of files is that of the logs.

A stream's offset is, per log, the bytes up to its last complete line. A log that the
meter still writes to gives its new lines to the next micro-batch; one that has not
grown costs an entry in the offset and nothing else.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.types import StructType

from wattframe.functions.scalars import parse_power_time
from wattframe.sources.append_log import open_path
from wattframe.sources.readers import PROCESS_LOG_COLUMNS, SYSTEM_LOG_COLUMNS

FORMAT = "wattframe_power_logs"
RANGE_BYTES = 64 << 20
TAIL = 1 << 16
READ_BYTES = 8 << 20
OPEN_BYTES = 128 << 10  # what opening a log counts as, so that a partition does not get too many small ones
BATCH_ROWS = 10_000
NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a log's name, which readers leave out

#: a log is a file of this name, or a folder of this name (perhaps as a partition value) holding part files
_NAME = re.compile(r"(?:^|/)(?:[^/=]+=)?run_(\d+)_repetition_(\d+)\.csv(?:-(\d+)\.csv)?(?:/[^/_.][^/]*)?$")
RAW = "run long, rep long, pid long, layout string, date string, cpu_util string, total_w string, cpu_w string, gpu_w string, file string"
_FIELDS = {"Date": "date", "CPU Utilization": "cpu_util", "Total Power": "total_w", "CPU Power": "cpu_w", "GPU Power": "gpu_w"}


@dataclass(frozen=True)
class LogRange:
    file: str
    run: int
    rep: int
    pid: int | None
    start: int
    end: int

    @property
    def layout(self) -> str:
        return "system" if self.pid is None else "process"


@dataclass
class LogPartition(InputPartition):
    ranges: tuple[LogRange, ...]

    def __init__(self, ranges: Sequence[LogRange]):
        self.ranges = tuple(ranges)


def log_of(file: str) -> tuple[int, int, int | None] | None:
    """(run, repetition, process) from a log's path; None if it is no power log."""
    m = _NAME.search(file)
    return (int(m[1]), int(m[2]), int(m[3]) if m[3] else None) if m else None


def _logs(folder: str) -> dict[str, tuple[int, tuple]]:
    """Path -> (size, what the name says) of all logs under a folder."""
    fs, base = open_path(folder)
    out = {}
    for info in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)):
        if info.type == pyarrow.fs.FileType.File and (name := log_of(info.path[len(base):])):
            out[info.path] = (info.size, name)
    return out


def plan(sizes: dict[str, tuple[int, int, tuple]], range_bytes: int) -> list[LogPartition]:
    """Partitions of (file -> start, end, name): ranges of ``range_bytes``, small ones together."""
    out, waiting, size = [], [], 0
    for file, (start, end, name) in sorted(sizes.items()):
        for a in range(start, end, range_bytes):
            b = min(a + range_bytes, end)
            cost = b - a + min(OPEN_BYTES, range_bytes // 2)
            if waiting and size + cost > range_bytes:
                out.append(LogPartition(waiting))
                waiting, size = [], 0
            waiting.append(LogRange(file, *name, a, b))
            size += cost
    return out + ([LogPartition(waiting)] if waiting else [])


def lines_of(source, start: int, end: int) -> Iterator[bytes]:
    """Blocks of whole lines that begin in [start, end) of a file."""
    at, size, rest = start, source.size(), b""
    if start:
        # the line that holds the byte before belongs to the range before, its line break included
        at = start - 1
        while True:
            block = source.read_at(min(TAIL, size - at), at)
            cut = block.find(b"\n")
            at += len(block) if cut < 0 else cut + 1
            if cut >= 0 or at >= size or not block:
                break
    while at < min(end, size) or rest:
        # ``rest`` is the beginning of a line that began in the range
        block = source.read_at(min(READ_BYTES, size - at), at) if at < size else b""
        last = not block
        begin, data = at - len(rest), rest + block
        at += len(block)
        if at >= end:  # up to the end of the line that begins last in the range
            cut = data.find(b"\n", max(0, end - 1 - begin))
            if cut >= 0 or last:
                yield data[: cut + 1] if cut >= 0 else data
                return
            rest = data
            continue
        cut = data.rfind(b"\n") + 1
        if cut:
            yield data[:cut]
        rest = data[cut:]
        if last:
            if rest:
                yield rest
            return


def read_ranges(folder: str, ranges: Sequence[LogRange]) -> Iterator[pa.RecordBatch]:
    """Rows of the ranges; those of small logs share a batch."""
    waiting, n = [], 0
    for table in _range_tables(folder, ranges):
        waiting.append(table)
        n += len(table)
        if n >= BATCH_ROWS:
            yield from pa.concat_tables(waiting).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)
            waiting, n = [], 0
    if waiting:
        yield from pa.concat_tables(waiting).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)


def _range_tables(folder: str, ranges: Sequence[LogRange]) -> Iterator[pa.Table]:
    fs, _ = open_path(folder)
    for r in ranges:
        names = SYSTEM_LOG_COLUMNS if r.pid is None else PROCESS_LOG_COLUMNS
        with fs.open_input_file(r.file) as source:
            first = r.start == 0
            for block in lines_of(source, r.start, r.end):
                if first:  # the header line
                    block = block[block.find(b"\n") + 1 :] if b"\n" in block else b""
                    first = False
                if block.strip():
                    yield _table(block, names, r)


def _table(block: bytes, names: Sequence[str], r: LogRange) -> pa.Table:
    table = pyarrow.csv.read_csv(
        io.BytesIO(block), pyarrow.csv.ReadOptions(column_names=list(names), use_threads=False),
        convert_options=pyarrow.csv.ConvertOptions(column_types={c: pa.string() for c in names}, strings_can_be_null=True, null_values=[""],
                                                   quoted_strings_can_be_null=True))
    n = len(table)
    columns = {"run": pa.array([r.run] * n, pa.int64()), "rep": pa.array([r.rep] * n, pa.int64()), "pid": pa.array([r.pid] * n, pa.int64()),
               "layout": pa.array([r.layout] * n, pa.string())}
    for source, name in _FIELDS.items():
        columns[name] = table[source].combine_chunks() if source in names else pa.nulls(n, pa.string())
    columns["file"] = pa.array([r.file] * n, pa.string())
    return pa.table(columns)


class PowerLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RAW

    def _args(self) -> tuple[str, int]:
        return self.options["path"].rstrip("/"), int(self.options.get("range_bytes", RANGE_BYTES))

    def reader(self, schema: StructType) -> PowerLogReader:
        return PowerLogReader(*self._args())

    def streamReader(self, schema: StructType) -> PowerLogStream:
        return PowerLogStream(*self._args())

    def writer(self, schema: StructType, overwrite: bool) -> PowerLogWriter:
        if overwrite:
            raise ValueError("power logs are not overwritten")
        return PowerLogWriter(self._args()[0], uuid.uuid4().hex[:12])


@dataclass
class LogsWritten(WriterCommitMessage):
    rows: int


class PowerLogWriter(DataSourceArrowWriter):
    """A part file of each log that a task gets, from rows that are sorted by ``log``. A part
    is written under a hidden name and then renamed; its final name tells the write and the
    partition, so a task that is run again replaces what it left."""

    def __init__(self, folder: str, write_id: str):
        self.folder, self.write_id = folder, write_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> LogsWritten:
        fs, base = open_path(self.folder)
        context = TaskContext.get()
        name = f"part-{self.write_id}-{context.partitionId():05d}.csv"
        hidden = f".{name}.{context.taskAttemptId()}"
        rows, log, out = 0, None, None

        def close():
            if out is not None:
                out.close()
                fs.move(f"{base}/log={log}/{hidden}", f"{base}/log={log}/{name}")

        for batch in iterator:
            logs, values = batch.column("log").fill_null(NO_NAME), batch.drop_columns(["log"])
            runs = pc.run_end_encode(logs)
            start = 0
            for end, of in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if of != log:
                    close()
                    log = of
                    fs.create_dir(f"{base}/log={log}", recursive=True)
                    out = fs.open_output_stream(f"{base}/log={log}/{hidden}")
                    out.write((",".join(values.schema.names) + "\n").encode())
                pyarrow.csv.write_csv(values.slice(start, end - start), out, pyarrow.csv.WriteOptions(include_header=False, quoting_style="none"))
                start = end
            rows += len(batch)
        close()
        return LogsWritten(rows)

    def commit(self, messages: list[LogsWritten | None]) -> None:
        pass

    def abort(self, messages: list[LogsWritten | None]) -> None:
        fs, base = open_path(self.folder)
        for info in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True, allow_not_found=True)):
            if f"part-{self.write_id}-" in info.base_name:
                fs.delete_file(info.path)


class PowerLogReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[LogPartition]:
        logs = _logs(self.folder)
        if not logs:
            raise FileNotFoundError(f"no power logs in {self.folder}")
        return plan({f: (0, size, name) for f, (size, name) in logs.items()}, self.range_bytes) or [LogPartition(())]

    def read(self, partition: LogPartition) -> Iterator[pa.RecordBatch]:
        return read_ranges(self.folder, partition.ranges)


class PowerLogStream(DataSourceStreamReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes
        self.complete: dict[str, tuple[int, int]] = {}  # file -> (size when looked at, bytes of whole lines)

    def initialOffset(self) -> dict:
        return {"logs": json.dumps({})}

    def latestOffset(self) -> dict:
        fs, base = open_path(self.folder)
        logs = {}
        for file, (size, _) in sorted(_logs(self.folder).items()):
            if self.complete.get(file, (-1, 0))[0] != size:
                self.complete[file] = (size, self._whole_lines(fs, file, size))
            if self.complete[file][1]:
                logs[file[len(base):]] = self.complete[file][1]
        return {"logs": json.dumps(logs)}

    @staticmethod
    def _whole_lines(fs, file: str, size: int) -> int:
        with fs.open_input_file(file) as source:
            end = size
            while end > 0:
                start = max(0, end - TAIL)
                cut = source.read_at(end - start, start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[LogPartition]:
        base = open_path(self.folder)[1]
        before, now = json.loads(start["logs"]), json.loads(end["logs"])
        grown = {base + f: (before.get(f, 0), b, log_of(f)) for f, b in now.items() if b > before.get(f, 0)}
        return plan(grown, self.range_bytes)

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: LogPartition) -> Iterator[pa.RecordBatch]:
        return read_ranges(self.folder, partition.ranges)


def power_samples(raw: DataFrame, ms_mode: str = "integer", bad_times: str = "raise") -> DataFrame:
    """Typed samples of raw log rows, batch or stream: run, rep, pid (NULL for system
    logs), layout, ts, cpu_util, total_w, cpu_w, gpu_w, file. A time that cannot be read
    is an error (``raise``) or leaves its row out (``drop``)."""
    if bad_times not in ("raise", "drop"):
        raise ValueError("bad_times must be 'raise' or 'drop'")
    out = raw.withColumn("ts", parse_power_time("date", ms_mode))
    if bad_times == "drop":
        out = out.where(F.col("ts").isNotNull())
    else:
        message = F.concat(F.lit("unreadable time in "), F.col("file"), F.lit(": "), F.coalesce("date", F.lit("NULL")))
        out = out.withColumn("ts", F.when(F.col("ts").isNull(), F.raise_error(message).cast("timestamp_ntz")).otherwise(F.col("ts")))
    return out.select("run", "rep", "pid", "layout", "ts", *[F.col(c).cast("double").alias(c) for c in ("cpu_util", "total_w", "cpu_w", "gpu_w")], "file")


def write_logs(rows: DataFrame, folder: str) -> None:
    """Append rows to the logs of a folder: ``log`` names the log of a row, the other columns
    are the log's, in the order of its layout, as text. Rows of a log are dealt to one
    task, of a log that is much larger than others to several."""
    rows.sparkSession.dataSource.register(PowerLogSource)
    text = rows.select("log", *[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns if c != "log"])
    (text.hint("rebalance", "log").sortWithinPartitions("log")
     .write.format(FORMAT).mode("append").save(folder))


def scan(spark: SparkSession, folder: str, ms_mode: str = "integer", bad_times: str = "raise", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All power logs of a folder."""
    spark.dataSource.register(PowerLogSource)
    return power_samples(spark.read.format(FORMAT).option("range_bytes", range_bytes).load(folder), ms_mode, bad_times)


def follow(spark: SparkSession, folder: str, ms_mode: str = "integer", bad_times: str = "raise", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same as a stream: logs as they appear and grow."""
    spark.dataSource.register(PowerLogSource)
    return power_samples(spark.readStream.format(FORMAT).option("range_bytes", range_bytes).load(folder), ms_mode, bad_times)
