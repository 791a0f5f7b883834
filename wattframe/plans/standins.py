"""The driver's tables, shaped into the study's tables.

Every registered query reads the driver's parquet tables and maps them onto

* power log        <- ``events``: run = ``user_id``, tie-break = ``event_id``,
                      CPU watts = ``value``, GPU watts = ``props.k``
* laptop run table <- ``lineitem``: platform = ``l_returnflag``, library =
                      ``l_linestatus``, energy = ``l_extendedprice`` / 1000 (kJ
                      scale keeps sums of squares well inside double precision),
                      time = ``l_quantity``, accuracy = ``l_discount`` in percent
* board run table  <- ``lineitem`` with the -999999 sentinel where a metric does
                      not apply (classification metrics on open lines,
                      regression metrics on finished lines)
* regression table <- ``lineitem`` joined to ``part``
* classification   <- ``embeddings`` (label 5 against the rest) and ``orders``
                      (status text F / O as the two-letter label)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTINEL = -999999


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def power_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.col("value").alias("cpu_w"),
        F.get_json_object("props", "$.k").cast("double").alias("gpu_w"),
    )


def laptop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_returnflag").alias("Platform"),
        F.col("l_linestatus").alias("Library_Name"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("Total_Energy_J"),
        F.col("l_quantity").alias("Time_Taken_s"),
        (F.col("l_discount") * F.lit(100.0)).alias("Accuracy_Pct"),
    )


def board_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-board run table with sentinels, before cleaning (Library not yet renamed)."""
    li = table(spark, sf_dir, "lineitem")
    is_cls = F.col("l_linestatus") == "O"
    sentinel = F.lit(float(SENTINEL))
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_returnflag").alias("Library"),
        F.col("l_linestatus").alias("Model_Type"),
        (F.col("l_quantity") * F.lit(1_000_000_000)).cast("bigint").alias("Duration_ns"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("CPU_Energy_J"),
        F.when(is_cls, F.col("l_discount") * F.lit(100.0)).otherwise(sentinel).alias("Accuracy_Pct"),
        F.when(is_cls & (F.col("l_tax") > 0), F.col("l_tax") * F.lit(100.0)).otherwise(sentinel).alias("Precision_Pct"),
        F.when(~is_cls, F.col("l_quantity") * F.col("l_tax")).otherwise(sentinel).alias("MSE"),
        F.when(~is_cls, F.lit(1.0) - F.col("l_discount")).otherwise(sentinel).alias("r2_score"),
    )


def regression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    return li.join(pa, li.l_partkey == pa.p_partkey, "inner").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "p_size", "p_retailprice", "p_type", "l_extendedprice",
    )


def embeddings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = table(spark, sf_dir, "embeddings")
    return em.select("vec_id", "embedding", (F.col("label") == 5).cast("int").alias("label"))


def laptop_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattframe.operators.clean import derive_laptop_metrics
    return derive_laptop_metrics(laptop_runs(spark, sf_dir))


def board_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board run table after cleaning: sentinel -> NULL, Library -> Library_Name, M1..M5."""
    from wattframe.operators.clean import derive_board_metrics, rename_columns, sentinel_to_null
    cleaned = rename_columns(sentinel_to_null(board_runs(spark, sf_dir)), {"Library": "Library_Name"})
    return derive_board_metrics(cleaned)
