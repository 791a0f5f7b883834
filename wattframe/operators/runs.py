
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions import scalars as S
from wattframe.operators.joins import join_small, unmatched_keys
from wattframe.operators.ranking import hash_positions, ordered_positions

#: levels of a factor become one row's arrays; more is an error, not a cut
MAX_LEVELS = 10_000


def design_matrix(source: DataFrame, factor_cols: Sequence[str], reps: int,
                  names: Sequence[str] | None = None) -> DataFrame:
    """Every combination of factor levels x ``reps`` repetitions.

    Levels are the sorted distinct values of each factor column of ``source``
    (collected by a partial aggregate; factor levels are few by nature).  The
    product is built by ``posexplode`` - a generator, not a join.  ``combo`` is
    the index of the combination in product order (first factor slowest),
    ``run_id`` is ``run_<combo>_repetition_<rep>``.
    """
    names = list(names or factor_cols)
    if reps < 1:
        raise ValueError("a design has at least one repetition")
    for c in factor_cols:  # factors have few levels; refuse a column that is not one
        if source.select(c).distinct().limit(MAX_LEVELS + 1).count() > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels; not a design factor")
    levels = source.agg(*[F.array_sort(F.collect_set(c)).alias(f"_l{i}") for i, c in enumerate(factor_cols)])
    df = levels
    for i in range(len(factor_cols)):
        df = df.select("*", F.posexplode(f"_l{i}").alias(f"_p{i}", names[i]))
    combo = F.lit(0)
    for i in range(len(factor_cols)):
        combo = combo * F.size(f"_l{i}") + F.col(f"_p{i}")
    df = df.withColumn("combo", combo.cast("int"))
    df = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    df = df.withColumn("run_id", F.concat(F.lit("run_"), F.col("combo").cast("string"),
                                          F.lit("_repetition_"), F.col("rep").cast("string")))
    return df.select(*names, "combo", "rep", "run_id")


def design_exclude(design: DataFrame, exclusions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Remove the listed factor combinations (left anti join on the factor columns)."""
    return join_small(design, exclusions.select(*on).distinct(), on=list(on), how="left_anti")


def shuffle_design(design: DataFrame, run_col: str = "run_id", seed: int = 42) -> DataFrame:
    """Seeded random run order: ``order_key`` = md5 hash of (seed, run id),
    ``position`` = 0-based place in that order."""
    d = design.withColumn("order_key", S.hash32(run_col, seed=seed))
    return hash_positions(d, "order_key", [run_col])


def lookup_by_key(runs: DataFrame, lookup: DataFrame, run_key: str, lookup_key: str,
                  strict: bool = False) -> DataFrame:
    """Attach lookup values to runs (left join).  With
    ``strict`` an unknown key raises, like a dict lookup."""
    if strict:
        missing = unmatched_keys(runs, lookup, run_key, lookup_key)
        if not missing.isEmpty():
            raise KeyError(f"keys without lookup entry, e.g. {missing.first()[0]!r}")
    return join_small(runs, lookup, on=runs[run_key] == lookup[lookup_key], how="left")


def latest_per_key(log: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str],
                   value_cols: Sequence[str]) -> DataFrame:
    """Last appended row per key (``iloc[-1]``): max by (order columns).

    ``max_by`` is a partial aggregate, so a key with many rows never needs to be
    sorted or held in one task."""
    order = F.struct(*[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c) for c in [*order_cols, *value_cols]])
    latest = log.groupBy(*key_cols).agg(F.max_by(payload, order).alias("_r"))
    return latest.select(*key_cols, *[F.col(f"_r.{c}").alias(c) for c in [*order_cols, *value_cols]])


def run_blocks(runs: DataFrame, order_cols: Sequence[str], block_size: int = 45,
               last_block_before: int = 150) -> DataFrame:
    """Running count of finished runs in time order, block number and the
    block-end flag (count multiple of ``block_size`` and below the total)."""
    p = ordered_positions(runs, order_cols)
    n = F.col("position") + 1
    return (p.withColumn("run_number", n)
            .withColumn("block", F.ceil(n / F.lit(block_size)).cast("long"))
            .withColumn("block_end", ((n % block_size) == 0) & (n < last_block_before))
            .drop("position"))


def union_by_name(frames: Sequence[DataFrame], renames: dict[str, str] | None = None) -> DataFrame:
    """Stack tables by column name; missing columns become NULL.  ``renames``
    maps spelling variants to one name first (``f1_score`` -> ``f1``)."""
    out = None
    for f in frames:
        if renames:
            f = f.withColumnsRenamed({k: v for k, v in renames.items() if k in f.columns})
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


METRIC_COLUMNS = ("accuracy", "precision", "MSE", "r2_score")


def unpack_metrics(log: DataFrame, metrics: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """Which of the metrics are present in each row; a row with none of them is
    a failed run.  Accuracy and precision are turned into percent and absent
    values become the sentinel, as the run table stores them."""
    out = log
    for m in metrics:
        if m not in out.columns:
            out = out.withColumn(m, F.lit(None).cast("double"))
    present = {m: F.col(m).isNotNull() for m in metrics}
    cls = present["accuracy"] | present["precision"]
    reg = present["MSE"] | present["r2_score"]
    return out.select(
        *[c for c in log.columns if c not in metrics],
        S.value_or_sentinel(S.fraction_to_pct("accuracy"), float(S.SENTINEL)).alias("Accuracy_Pct"),
        S.value_or_sentinel(S.fraction_to_pct("precision"), float(S.SENTINEL)).alias("Precision_Pct"),
        S.value_or_sentinel("MSE", float(S.SENTINEL)).alias("MSE"),
        S.value_or_sentinel("r2_score", float(S.SENTINEL)).alias("r2_score"),
        cls.alias("measurements_class"), reg.alias("measurements_reg"), (~cls & ~reg).alias("failed"),
    )


def assemble_run_table(runs: DataFrame, energy: DataFrame, metrics: DataFrame, run_key: str,
                       energy_key: str, metrics_key: str) -> DataFrame:
    """Run -> energy of that run -> latest metrics of its model; failure defaults.

    Both joins are left equi-joins on one row per key (energy and metrics are
    already aggregated per run / model), so no key is skewed.  Missing energy
    gives 0.0 J, no start time and duration -999999; missing metrics give
    -999999 and model name ``FAILED``.
    """
    j = (runs.join(energy, runs[run_key] == energy[energy_key], "left")
         .join(metrics, runs[run_key] == metrics[metrics_key], "left"))
    return j.select(
        runs[run_key].alias("run_id"),
        *[runs[c] for c in runs.columns if c != run_key],
        F.col("start_ts").alias("Timestamp_Start"),
        S.value_or_sentinel(F.round(F.col("span_s") * F.lit(1e9)).cast("bigint"), S.SENTINEL).alias("Duration_ns"),
        F.coalesce(F.col("energy_j"), F.lit(0.0)).alias("CPU_Energy_J"),
        S.value_or_sentinel("accuracy_pct", float(S.SENTINEL)).alias("Accuracy_Pct"),
        S.value_or_sentinel("model", "FAILED").alias("Model_Name"),
    )


def assemble_board_run_table(runs: DataFrame, energy: DataFrame, metrics: DataFrame, run_key: str, energy_key: str,
                             metrics_key: str) -> DataFrame:
    """The whole row of the board layout: energy and start of the run, its own measured
    duration (``duration_ns``; the span of the log where the run has none), and the
    unpacked metrics of its model.  ``metrics`` has what ``unpack_metrics`` gives and
    ``model``.  A run without metrics has sentinels and the model ``FAILED``."""
    sentinel = F.lit(float(S.SENTINEL))
    j = runs.join(energy, runs[run_key] == energy[energy_key], "left").join(metrics, runs[run_key] == metrics[metrics_key], "left")
    span = F.round(F.col("span_s") * F.lit(1e9)).cast("bigint")
    return j.select(
        F.concat(F.lit("run_"), runs[run_key].cast("string")).alias("__run_id"), F.lit("DONE").alias("__done"), runs["Library"], runs["Model_Type"],
        F.col("start_ts").alias("Timestamp_Start"),
        F.coalesce(runs["duration_ns"], span, F.lit(S.SENTINEL).cast("bigint")).alias("Duration_ns"),
        F.coalesce(F.col("energy_j"), F.lit(0.0)).alias("CPU_Energy_J"),
        *[F.coalesce(F.col(c), sentinel).alias(c) for c in ("Accuracy_Pct", "Precision_Pct", "MSE", "r2_score")],
        F.coalesce(F.when(~F.col("failed"), F.col("model")), F.lit("FAILED")).alias("Model_Name"))


def assemble_laptop_run_table(runs: DataFrame, energy: DataFrame, metrics: DataFrame, run_key: str, energy_key: str,
                              metrics_key: str) -> DataFrame:
    """The row of the laptop layout: CPU, GPU and total energy, seconds, accuracy.  A
    failed run has accuracy 0.0 there, not a sentinel, and energies of 0.0."""
    j = runs.join(energy, runs[run_key] == energy[energy_key], "left").join(metrics, runs[run_key] == metrics[metrics_key], "left")
    cpu, gpu = F.coalesce(F.col("cpu_j"), F.lit(0.0)), F.coalesce(F.col("gpu_j"), F.lit(0.0))
    return j.select(
        F.concat(F.lit("run_"), runs[run_key].cast("string")).alias("__run_id"), F.lit("DONE").alias("__done"), runs["Block_Type"],
        S.key_prefix(runs["Block_Type"]).alias("Library_Name"), F.col("start_ts").alias("Timestamp_Start"),
        (cpu + gpu).alias("Total_Energy_J"), cpu.alias("CPU_Energy_J"), gpu.alias("GPU_Energy_J"),
        F.coalesce(F.col("seconds"), F.lit(0.0)).alias("Time_Taken_s"),
        F.coalesce(F.col("accuracy_pct"), F.lit(0.0)).alias("Accuracy_Pct"),
        F.coalesce(F.col("model"), F.lit("FAILED")).alias("Model_Name"))
