"""Deterministic train/test splits and mini-batch assignment.

The split hash is the first 8 hex digits of md5('seed:key') (``hash32``): it
depends only on the row key, never on partitioning or task order, so a retried
task or a re-run sees the same split (``randomSplit`` does not guarantee that).

* Bernoulli mode: test when hash / 2^32 < fraction.  No shuffle at all.
* Exact mode: exactly ceil(fraction * n) test rows (per stratum), the ones with
  the smallest hash.  Rows are counted per 2^16 hash bucket (a small table, made
  once), the cut bucket of each stratum is found from the cumulative counts and
  broadcast (joined, beyond ``MOST_GROUPS`` strata), and only the rows of the cut
  bucket are ranked and shuffled.  The key must be unique for exact mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.scalars import TWO32, hash32
from wattframe.operators.permute import permuted, round_keys
from wattframe.operators.ranking import hash_positions
from wattframe.operators.selection import MOST_GROUPS, frozen_small, renamed_keys, same_group

BUCKET_BITS = 16


def with_split_hash(df: DataFrame, key_cols: Sequence[str], seed: int = 42, name: str = "split_hash") -> DataFrame:
    return df.withColumn(name, hash32(*key_cols, seed=seed))


def bernoulli_split(df: DataFrame, key_cols: Sequence[str], fraction: float, seed: int = 42,
                    out: str = "is_test") -> DataFrame:
    d = with_split_hash(df, key_cols, seed)
    return d.withColumn(out, F.col("split_hash") < F.lit(fraction * TWO32))


def exact_split(df: DataFrame, key_cols: Sequence[str], fraction: float, seed: int = 42,
                strata: Sequence[str] = (), out: str = "is_test") -> DataFrame:
    """Exactly ceil(fraction * n_stratum) rows per stratum flagged as test."""
    strata = list(strata)
    d = with_split_hash(df, key_cols, seed).withColumn("_hb", F.shiftright("split_hash", 32 - BUCKET_BITS))
    counts = d.groupBy(*strata, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    w_cum = Window.partitionBy(*strata).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    cum = (counts.withColumn("_before", F.coalesce(F.sum("_c").over(w_cum), F.lit(0)))
           .withColumn("_n", F.sum("_c").over(Window.partitionBy(*strata)))
           .withColumn("_k", F.ceil(F.lit(float(fraction)) * F.col("_n"))))
    # a row per stratum: its cut bucket and how many rows of that one are test rows
    at_cut = (F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_c"))
    cuts, n_strata = frozen_small(cum.groupBy(*strata).agg(
        F.max(F.when(at_cut, F.col("_hb"))).alias("_cut"), F.max(F.when(at_cut, F.col("_k") - F.col("_before"))).alias("_rem")))
    marks = renamed_keys(cuts, strata, "_m", ["_cut", "_rem"])
    if n_strata <= MOST_GROUPS:
        marks = F.broadcast(marks)  # the rows stay where they are
    marked = d.join(marks, same_group(strata, "_m"), "inner")
    in_cut = F.coalesce(F.col("_hb") == F.col("_cut"), F.lit(False))
    rest = marked.where(~in_cut).withColumn(out, F.coalesce(F.col("_hb") < F.col("_cut"), F.lit(False)))
    w_rank = Window.partitionBy(*strata).orderBy("split_hash", *key_cols)  # the cut bucket's rows only
    cut = (marked.where(in_cut).withColumn("_r", F.row_number().over(w_rank))
           .withColumn(out, F.col("_r") <= F.col("_rem")).drop("_r"))
    return rest.unionByName(cut).drop("_hb", "_cut", "_rem", *[f"_m{i}" for i in range(len(strata))])


def stratified_split(df: DataFrame, key_cols: Sequence[str], label: str, fraction: float,
                     seed: int = 42, out: str = "is_test") -> DataFrame:
    """Exact split inside each class, so class shares stay within one row."""
    return exact_split(df, key_cols, fraction, seed, strata=[label], out=out)


def shuffled_batches(df: DataFrame, key_cols: Sequence[str], batch_size: int, epochs: int,
                     seed: int = 42, tiebreak_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (row, epoch) with ``batch``: rows in a fresh random order per
    epoch, cut into batches of ``batch_size`` (the last one smaller).

    Rows are numbered once, by hash of the key, then key and ``tiebreak_cols`` (rows
    equal in all of them are interchangeable, so the result does not depend on task
    order).  Each epoch permutes these numbers by a keyed permutation, so its batch
    numbers are arithmetic on the row: no row is shuffled once per epoch."""
    rows = hash_positions(df.withColumn("_bh", hash32(*key_cols, seed=seed)), "_bh", [*key_cols, *tiebreak_cols])
    n = df.count()
    keys = F.array(*[F.array(*[F.lit(k).cast("long") for k in round_keys(seed, e)]) for e in range(epochs)])
    e = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    place = permuted(F.col("position"), n, F.get(keys, F.col("epoch")))
    return e.withColumn("batch", F.floor(place / F.lit(batch_size)).cast("long")).drop("_bh", "position")
