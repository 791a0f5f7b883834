"""Writers: metrics logs (append) and the run table.

The trainer scripts re-read and rewrite a whole CSV per appended row; here a
row (or many) is appended as new files in the superset schema, so appends are
O(rows appended) and layouts never drift.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.sources import append_log
from wattframe.sources.readers import BOARD_RUN_TABLE_COLUMNS, LAPTOP_RUN_TABLE_COLUMNS, normalise_metrics


def append_metrics_csv(df: DataFrame, path: str, partition_by: str | None = None, append_id: str | None = None) -> None:
    """Append metrics rows to a CSV log in the fixed superset schema.  A ``partition_by``
    column turns into folder names, which a reader may retype (``007`` to 7).  With an
    ``append_id`` the rows are added once, however often the job is run (``append_log``)."""
    out = normalise_metrics(df).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    if append_id is not None:
        _once_only(partition_by)
        lines, header = append_log.csv_lines(out)
        append_log.append_lines(lines, path, append_id, ".csv", header)
        return
    w = out.write.mode("append").option("header", True)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def append_metrics_json(df: DataFrame, path: str, partition_by: str | None = None, append_id: str | None = None) -> None:
    """Append metrics rows as JSON lines; time stamps stay ISO text.  ``append_id`` as for CSV."""
    out = normalise_metrics(df).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    if append_id is not None:
        _once_only(partition_by)
        append_log.append_lines(append_log.json_lines(out), path, append_id, ".json")
        return
    w = out.write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def _once_only(partition_by: str | None) -> None:
    if partition_by:
        raise ValueError("an append with an identifier is one folder: give no partition_by")


def append_run_table(df: DataFrame, path: str, append_id: str, layout: str = "board",
                     timestamp_format: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> None:
    """Add finished runs to a run table, all columns of its layout, once per ``append_id``.
    A missing start is written as the text FAILED, as the runner does."""
    names = BOARD_RUN_TABLE_COLUMNS if layout == "board" else LAPTOP_RUN_TABLE_COLUMNS
    start = F.coalesce(F.date_format("Timestamp_Start", timestamp_format), F.lit("FAILED")).alias("Timestamp_Start")
    rows = df.select(*[start if c == "Timestamp_Start" else F.col(c) for c in names])
    lines, header = append_log.csv_lines(rows)
    append_log.append_lines(lines, path, append_id, ".csv", header)


def write_json_array(df: DataFrame, path: str) -> None:
    """Write each partition as one file that holds a JSON array of its records."""
    def lines(batches):
        first = True
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first and not i else ",") + r for i, r in enumerate(rows)])], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    text = df.select(F.to_json(F.struct(*df.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))
    text.mapInArrow(lines, "value string").write.mode("append").text(path)


def write_run_table(df: DataFrame, path: str, fmt: str = "csv",
                    timestamp_format: str = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") -> None:
    """Write the whole run table produced by the batch job (overwrite)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", timestamp_format) \
            .option("timestampFormat", timestamp_format).csv(path)
    else:
        w.format(fmt).save(path)
