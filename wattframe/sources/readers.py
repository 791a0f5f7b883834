"""Readers for the study's file layouts.

All readers take explicit schemas where the layout is known (no schema
inference on large inputs) and return lazy DataFrames.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.functions.scalars import parse_power_time
from wattframe.operators.ranking import ordered_positions

log = logging.getLogger(__name__)

# Column layouts written by the power meter and the experiment runner.
SYSTEM_LOG_COLUMNS = ["Date", "CPU Utilization", "Total Power", "CPU Power", "GPU Power"]
PROCESS_LOG_COLUMNS = ["Date", "CPU Utilization", "CPU Power"]
HEADERLESS_POWER_COLUMNS = ["Date", "CPU_Utilization", "Total_P", "CPU_P", "GPU_P"]
LAPTOP_RUN_TABLE_COLUMNS = ["__run_id", "__done", "Block_Type", "Library_Name", "Timestamp_Start",
                            "Total_Energy_J", "CPU_Energy_J", "GPU_Energy_J", "Time_Taken_s", "Accuracy_Pct",
                            "Model_Name"]
BOARD_RUN_TABLE_COLUMNS = ["__run_id", "__done", "Library", "Model_Type", "Timestamp_Start", "Duration_ns",
                           "CPU_Energy_J", "Accuracy_Pct", "Precision_Pct", "MSE", "r2_score", "Model_Name"]
METRICS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()), T.StructField("model", T.StringType()),
    T.StructField("r2_score", T.DoubleType()), T.StructField("MSE", T.DoubleType()),
    T.StructField("RMSE", T.DoubleType()), T.StructField("MAE", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("f1", T.DoubleType()),
    T.StructField("num_classes", T.IntegerType()), T.StructField("random_seed", T.IntegerType()),
    T.StructField("test_size", T.DoubleType()), T.StructField("epochs", T.IntegerType()),
    T.StructField("batch_size", T.IntegerType()),
])
METRIC_RENAMES = {"f1_score": "f1"}

# keys from the log name: a file name, or a folder name holding the log's part files
_RUN_FILE_RE = r"run_(\d+)_repetition_(\d+)\.csv(?:-(\d+)\.csv)?(?=/[^/]*$|$)"
# system logs end in repetition_<digits>.csv, per-process logs in .csv-<pid>.csv; the first
# glob also matches the second kind, which is told apart by the name
_SYSTEM_GLOB = "run_*_repetition_*.csv"
_SYSTEM_NAME = r"run_\d+_repetition_\d+\.csv(/[^/]*)?$"
_PROCESS_GLOB = "run_*_repetition_*.csv-*.csv"


def _string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def scan_csv_header(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line; explicit schema when given, else inferred (small files only)."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def scan_csv_headerless(spark: SparkSession, path: str, schema: T.StructType | str,
                        require_rows: bool = True) -> DataFrame:
    """CSV without header, columns named by position; an empty input is an error."""
    df = spark.read.option("header", False).schema(schema).csv(path)
    if require_rows and df.isEmpty():
        raise ValueError(f"power log is empty: {path}")
    return df


def headerless_power_schema() -> T.StructType:
    return T.StructType([T.StructField("Date", T.TimestampNTZType())]
                        + [T.StructField(c, T.DoubleType()) for c in HEADERLESS_POWER_COLUMNS[1:]])


def _scan_layout(spark: SparkSession, directory: str, glob: str, names: Sequence[str]) -> DataFrame | None:
    try:
        df = (spark.read.option("header", True).option("enforceSchema", True)
              .schema(_string_schema(names)).csv(f"{directory.rstrip('/')}/{glob}"))
        return df.select("*", F.col("_metadata.file_path").alias("_file"))
    except AnalysisException as e:  # no file of this layout
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def _scan_folders(spark: SparkSession, directory: str, globs: dict[str, tuple[Sequence[str], str]]) -> dict[str, DataFrame | None]:
    """Glob -> text table of the part files in folders of that name, with columns by place;
    the paths also match the pattern beside the columns. The logs are listed and read by
    tasks, so that the driver holds nothing per log."""
    from wattframe.sources.log_tree import LogTree  # that module uses the power-log source, which uses this one
    try:
        tree = LogTree(spark, directory, list(globs), [pattern for _, pattern in globs.values()])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        log.warning("%s is read through Spark's own listing: %s", directory, e)  # a store that Arrow can't open
        return _scan_folders_listed(spark, directory, globs)
    return {glob: tree.csv(i, names) if tree.found[i] else None for i, (glob, (names, _)) in enumerate(globs.items())}


def _scan_folders_listed(spark: SparkSession, directory: str, globs: dict[str, tuple[Sequence[str], str]]) -> dict[str, DataFrame | None]:
    """The same in any store of Spark's, with an entry per log on the driver. The tree is
    listed once for all globs; a glob on the driver would list every log's folder by
    itself, and once more for each layout."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = {}
    for glob in globs:
        folders = hadoop.Path(f"{directory.rstrip('/')}/{glob.rpartition('/')[0]}")
        found[glob] = len(folders.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folders) or []) > 0
    if not any(found.values()):
        return dict.fromkeys(globs)
    widest = max(len(names) for names, _ in globs.values())
    files = (spark.read.option("header", True).option("enforceSchema", True).option("recursiveFileLookup", True)
             .schema(_string_schema([f"_c{i}" for i in range(widest)])).csv(directory))
    out = {}
    for glob, (names, name_re) in globs.items():
        pattern = "/" + "/".join("[^/]*".join(re.escape(x) for x in part.split("*")) for part in glob.split("/")) + "$"
        here = files.where(F.col("_metadata.file_path").rlike(pattern) & F.col("_metadata.file_path").rlike(name_re))
        out[glob] = here.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)],
                                F.col("_metadata.file_path").alias("_file")) if found[glob] else None
    return out


def scan_power_logs(spark: SparkSession, directory: str, ms_mode: str = "integer",
                    system_glob: str = _SYSTEM_GLOB, process_glob: str = _PROCESS_GLOB,
                    bad_times: str = "raise") -> DataFrame:
    """All power logs of a folder, both layouts, with run / repetition / pid from
    the log name.  The two layouts are scanned apart (one glob each) and united
    by column name, so per-process CPU power never lands under total power.
    The globs default to the meter's flat file names; a log may also be a
    folder of that name holding part files (give two globs ending in ``/*.csv``, of names and ``*``).

    A time that cannot be read is an error (``bad_times="raise"``) or leaves its row
    out (``"drop"``); it never counts as a sample without a time.

    Output: run, rep, pid (NULL for system logs), layout, ts, cpu_util,
    total_w, cpu_w, gpu_w, file."""
    parts = []
    if all(re.fullmatch(r"[\w=.*-]+/[\w=.*-]+", g) for g in (system_glob, process_glob)):
        layouts = _scan_folders(spark, directory, {system_glob: (SYSTEM_LOG_COLUMNS, _SYSTEM_NAME), process_glob: (PROCESS_LOG_COLUMNS, "")})
        sysdf, procdf = layouts[system_glob], layouts[process_glob]
    else:
        sysdf = _scan_layout(spark, directory, system_glob, SYSTEM_LOG_COLUMNS)
        procdf = _scan_layout(spark, directory, process_glob, PROCESS_LOG_COLUMNS)
    if sysdf is not None:
        sysdf = sysdf.where(F.col("_file").rlike(_SYSTEM_NAME))
        parts.append(sysdf.select(
            F.lit("system").alias("layout"), "_file", F.col("Date").alias("_date"),
            F.col("CPU Utilization").cast("double").alias("cpu_util"),
            F.col("Total Power").cast("double").alias("total_w"),
            F.col("CPU Power").cast("double").alias("cpu_w"),
            F.col("GPU Power").cast("double").alias("gpu_w")))
    if procdf is not None:
        parts.append(procdf.select(
            F.lit("process").alias("layout"), "_file", F.col("Date").alias("_date"),
            F.col("CPU Utilization").cast("double").alias("cpu_util"),
            F.col("CPU Power").cast("double").alias("cpu_w")))
    if not parts:
        raise FileNotFoundError(f"no power logs in {directory}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if bad_times not in ("raise", "drop"):
        raise ValueError("bad_times must be 'raise' or 'drop'")
    out = out.withColumn("_ts", parse_power_time("_date", ms_mode))
    if bad_times == "drop":
        out = out.where(F.col("_ts").isNotNull())
    else:
        message = F.concat(F.lit("unreadable time in "), F.col("_file"), F.lit(": "), F.coalesce("_date", F.lit("NULL")))
        out = out.withColumn("_ts", F.when(F.col("_ts").isNull(), F.raise_error(message).cast("timestamp_ntz")).otherwise(F.col("_ts")))
    return out.select(
        F.regexp_extract("_file", _RUN_FILE_RE, 1).cast("int").alias("run"),
        F.regexp_extract("_file", _RUN_FILE_RE, 2).cast("int").alias("rep"),
        F.when(F.regexp_extract("_file", _RUN_FILE_RE, 3) != "",
               F.regexp_extract("_file", _RUN_FILE_RE, 3).cast("int")).alias("pid"),
        "layout", F.col("_ts").alias("ts"),
        "cpu_util", "total_w", "cpu_w", "gpu_w", F.col("_file").alias("file"))


def normalise_metrics(df: DataFrame) -> DataFrame:
    """Rename spelling variants and cast to the superset metrics schema (absent columns NULL)."""
    for variant, name in METRIC_RENAMES.items():
        if variant in df.columns:
            df = (df.withColumn(name, F.coalesce(name, variant)).drop(variant) if name in df.columns
                  else df.withColumnRenamed(variant, name))
    cols = []
    for f in METRICS_SCHEMA.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if isinstance(f.dataType, T.TimestampNTZType):
                c = F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")
            cols.append(c.cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def scan_metrics_log(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A metrics log (any of the layouts) in the superset schema."""
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)  # names from the header, all text: no inference pass
    elif fmt == "json":
        raw = spark.read.schema(_string_schema([*METRICS_SCHEMA.names, *METRIC_RENAMES])).json(path)
    else:
        raw = spark.read.format(fmt).load(path)
    return normalise_metrics(raw)


def scan_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                      multi_line: bool = True) -> DataFrame:
    """A JSON array of records per file (``multi_line``), or JSON lines."""
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def run_table_schema(layout: str = "laptop") -> T.StructType:
    names = LAPTOP_RUN_TABLE_COLUMNS if layout == "laptop" else BOARD_RUN_TABLE_COLUMNS
    return _string_schema(names)


def scan_run_table(spark: SparkSession, path: str, layout: str = "laptop") -> DataFrame:
    """Run table CSV (a blank first line is tolerated).  ``Timestamp_Start`` text
    ``FAILED`` becomes NULL; numbers are typed, -999999 kept (clean later)."""
    schema = run_table_schema(layout)
    raw = spark.read.option("header", True).schema(schema).csv(path).select(*schema.names)  # folder names are no columns
    ints = {"Duration_ns"}
    texts = {"__run_id", "__done", "Block_Type", "Library_Name", "Library", "Model_Type", "Model_Name"}
    cols = []
    for c in raw.columns:
        if c == "Timestamp_Start":
            cols.append(F.try_to_timestamp(F.col(c)).cast("timestamp_ntz").alias(c))
        elif c in texts:
            cols.append(F.col(c))
        elif c in ints:
            cols.append(F.col(c).try_cast("bigint").alias(c))
        else:
            cols.append(F.col(c).try_cast("double").alias(c))
    return raw.select(*cols)


def scan_run_order(spark: SparkSession, path: str, column: str = "ml_library") -> DataFrame:
    """One column of a small CSV as an ordered list (pos, value).  A missing
    file or column gives an empty result and a logged error, as the runner does."""
    empty = spark.createDataFrame([], f"pos long, {column} string")
    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        log.error("run order file not readable: %s (%s)", path, e)
        return empty
    if column not in df.columns:
        log.error("column %s not in %s", column, path)
        return empty
    # the order of the lines: by file name, place of the block in the file, line in the block
    lines = df.select(F.col(column), F.col("_metadata.file_name").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_line"))
    return ordered_positions(lines, ["_file", "_at", "_line"]).select(F.col("position").alias("pos"), column)
