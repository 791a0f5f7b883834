"""Appends that happen once: a data source whose commit is named by the caller.

An append has an identifier (a run, a batch number). Its tasks write files into a
staging folder of their own and report them; the driver's commit keeps the reported
files, writes a manifest beside them and renames the folder to ``append=<id>``. So

- a job that dies half-way leaves only a staging folder, which readers do not see
  (its name begins with an underscore) and the next try does not need;
- a job that is run again after its commit finds the folder and changes nothing;
- of two that run at once, the one that renames first wins, the other withdraws;
- files of task attempts that Spark did not commit are deleted with the staging.

Readers use the folder as any table of text, CSV or JSON lines; the folder name gives
them the append's identifier as the column ``append``. The rename has to be atomic,
as on HDFS or a shared file system.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "wattframe_append"
MANIFEST = "_manifest.json"
_ID = re.compile(r"[A-Za-z0-9._-]+")


def open_path(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")


def exists(path: str) -> bool:
    fs, p = open_path(path)
    return fs.get_file_info(p).type != pyarrow.fs.FileType.NotFound


@dataclass
class FileWritten(WriterCommitMessage):
    file: str | None
    rows: int


class AppendSource(DataSource):
    """Rows of one text column, a line each. Options: ``path``, ``append_id``, ``suffix``
    of the files and, for each file, a first line ``header``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> AppendWriter:
        if overwrite:
            raise ValueError("an append log is not overwritten")
        return AppendWriter(self.options["path"], self.options["append_id"], self.options.get("suffix", ".txt"), self.options.get("header"))


class AppendWriter(DataSourceArrowWriter):
    def __init__(self, path: str, append_id: str, suffix: str, header: str | None):
        self.path, self.append_id, self.suffix, self.header = path.rstrip("/"), append_id, suffix, header
        self.staging = f"{self.path}/_staging/{append_id}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FileWritten:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}{self.suffix}"
        fs, base = open_path(self.staging)
        out, rows = None, 0
        try:
            for batch in iterator:
                if batch.num_rows and out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}")
                    if self.header:
                        out.write((self.header + "\n").encode())
                if batch.num_rows:
                    out.write(("\n".join(batch.column(0).to_pylist()) + "\n").encode())
                    rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return FileWritten(name if rows else None, rows)

    def commit(self, messages: Sequence[FileWritten]) -> None:
        fs, base = open_path(self.staging)
        _, final = open_path(f"{self.path}/append={self.append_id}")
        kept = {m.file: m.rows for m in messages if m is not None and m.file}
        fs.create_dir(base, recursive=True)
        for info in fs.get_file_info(pyarrow.fs.FileSelector(base)):
            if info.base_name not in kept:
                fs.delete_file(info.path)
        with fs.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps({"append_id": self.append_id, "files": kept}).encode())
        if exists(f"{self.path}/append={self.append_id}"):
            self._drop()
            return
        try:
            fs.move(base, final)
        except OSError:
            if not exists(f"{self.path}/append={self.append_id}/{MANIFEST}"):
                raise
            self._drop()  # the same append was committed in between

    def abort(self, messages: Sequence[FileWritten]) -> None:
        self._drop()

    def _drop(self) -> None:
        if exists(self.staging):
            fs, base = open_path(self.staging)
            fs.delete_dir(base)


def append_lines(lines: DataFrame, path: str, append_id: str, suffix: str, header: str | None = None) -> None:
    """Append rows of one text column once under ``append_id``."""
    if not _ID.fullmatch(append_id):
        raise ValueError(f"an append identifier has letters, digits, dots, dashes and underscores only: {append_id!r}")
    if exists(f"{path.rstrip('/')}/append={append_id}"):
        return
    lines.sparkSession.dataSource.register(AppendSource)
    w = lines.write.format(FORMAT).mode("append").option("path", path).option("append_id", append_id).option("suffix", suffix)
    if header is not None:
        w = w.option("header", header)
    w.save()


def csv_lines(df: DataFrame, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Rows as CSV lines, and the line of the column names. Line breaks inside a value
    are an error: a line is a row."""
    line: Column = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options or {})
    checked = F.when(line.rlike("[\\r\\n]"), F.raise_error(F.lit("a value holds a line break")).cast("string")).otherwise(line)
    return df.select(checked.alias("value")), ",".join('"' + c.replace('"', '\\"') + '"' if re.search(r'[",\s]', c) else c for c in df.columns)


def json_lines(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options or {}).alias("value"))


def appends(spark: SparkSession, path: str) -> DataFrame:
    """(append_id, files, rows): what was appended, from the manifests."""
    fs, base = open_path(path.rstrip("/"))
    names = [i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(base)) if i.base_name.startswith("append=")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(path.rstrip("/"))
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}/{MANIFEST}") as f:
                    out.append(json.loads(f.read()))
            yield pa.RecordBatch.from_pydict({
                "append_id": pa.array([m["append_id"] for m in out], pa.string()), "files": pa.array([len(m["files"]) for m in out], pa.int64()),
                "rows": pa.array([sum(m["files"].values()) for m in out], pa.int64())})

    return spark.createDataFrame([(n,) for n in names], "name string").mapInArrow(read, "append_id string, files long, rows long")
