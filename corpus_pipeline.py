"""Corpus pipeline: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table. ``run`` writes it as
Parquet into the shared checkpoint folder and reads it again for the next stage,
so a lost executor costs at most the tasks of one stage. The first three stages
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm import packing, quality_rules, secret_scan, simhash
from wattframe.llm.queries import bpe_files
from wattframe.session import scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled rule go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    return secret_scan.remove_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 1024 tokens."""
    return packing.pack(docs, F.col("doc_id"), **bpe_files()).withColumnRenamed("kept", "doc_id")


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", drop_copies),
    ("secret_scans", remove_secrets),
    ("packing", pack),
]

#: fingerprints and tokens are not expressible in SQL; the tests hold a brute-force version against run()
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
