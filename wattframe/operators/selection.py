"""Exact quantiles per group by selection between bounds of a sketch.

Pass one makes a mergeable quantile sketch per group (Spark's ``percentile_approx``,
whose rank error is bounded) and takes from it, for each wanted quantile, a value
surely not above and one surely not below it. Pass two counts, per group, the rows
below the lower bound, and keeps the rows between the bounds, as counts of distinct
values. Only these are shuffled: about ``4 / accuracy`` of a group for a quantile. The
wanted positions are then read off the ranked rest, exactly (linear interpolation,
R type 7). That a position lies between its bounds is checked; if a sketch were ever
wrong the result would be an error, not a value nearby.

Rows meet a group's bounds by broadcast while there are at most ``MOST_GROUPS`` groups
(counted; a row of a few numbers each), beyond that groups are small and
``ranking.exact_quantiles`` deals their distinct values out by range. Where very many
rows lie between bounds (a group of billions) they go the same way.

Every group keeps its row, also one of NULLs only (its quantiles are NULL) and the
group whose key is NULL. NaN is not a value here: turn it into NULL first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.operators.ranking import exact_quantiles
from wattframe.session import ensure_checkpoint_dir

ACCURACY = 2_000
MOST_GROUPS = 10_000
MOST_BETWEEN = 2_000_000


def frozen_small(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpointed table of one row per group and its number of rows."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out, out.count()


def same_group(keys: Sequence[str], prefix: str) -> Column:
    """NULL-safe equality of the key columns with ``prefix0``, ``prefix1`` ..."""
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return on


def renamed_keys(df: DataFrame, keys: Sequence[str], prefix: str, values: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{i}") for i, c in enumerate(keys)], *values)


def _bounds(df: DataFrame, value: str, keys: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """Per group: ``_n`` values, and for each probability ``_lo<i>`` and ``_hi<i>``."""
    slack = 2.0 / accuracy
    wanted = sorted({p for q in probs for p in (q - slack, q + slack) if 0.0 < p < 1.0})
    aggs = [F.count(value).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max")]
    if wanted:
        aggs.append(F.percentile_approx(value, wanted, accuracy).alias("_sketch"))
    cols = []
    for i, q in enumerate(probs):
        for name, p, end in ((f"_lo{i}", q - slack, "_min"), (f"_hi{i}", q + slack, "_max")):
            cols.append((F.get("_sketch", F.lit(wanted.index(p))) if 0.0 < p < 1.0 else F.col(end)).alias(name))
    return df.groupBy(*keys).agg(*aggs).select(*keys, "_n", "_min", "_max", *cols)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with a column per entry of ``probs``. ``df`` is read twice."""
    keys, names, ps = list(keys), list(probs), [float(p) for p in probs.values()]
    rows = df.select(*keys, F.col(value).alias("_v"))
    bounds, n_groups = frozen_small(_bounds(rows, "_v", keys, ps, accuracy))
    if n_groups > MOST_GROUPS:
        return exact_quantiles(df, value, probs, keys)
    # of a small group, whose sketch has few ranks to spare, all values are kept
    small = F.col("_n") <= 2 * accuracy
    marks = [F.when(small, F.col(end)).otherwise(F.col(f"{side}{i}")).alias(f"{side}{i}")
             for i in range(len(ps)) for side, end in (("_lo", "_min"), ("_hi", "_max"))]
    near = rows.where(F.col("_v").isNotNull()).join(F.broadcast(renamed_keys(bounds, keys, "_k", marks)), same_group(keys, "_k"))
    # per quantile: the value if it lies between the bounds, NULL for a row below them, nothing above
    seen = F.filter(F.array(*[
        F.when(F.col("_v") <= F.col(f"_hi{i}"), F.struct(F.lit(i).alias("i"), F.when(F.col("_v") >= F.col(f"_lo{i}"), F.col("_v")).alias("v")))
        for i in range(len(ps))]), lambda x: x.isNotNull())
    counts = near.select(*keys, F.inline(seen).alias("_i", "_x")).groupBy(*keys, "_i", "_x").agg(F.count(F.lit(1)).alias("_c"))
    counts, n_counts = frozen_small(counts)
    if n_counts > MOST_BETWEEN:
        return exact_quantiles(df, value, probs, keys)
    # NULL, the rows below, comes first
    upto = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (counts.withColumn("_to", F.sum("_c").over(upto))
              .join(renamed_keys(bounds, keys, "_b", ["_n"]), same_group(keys, "_b")))
    at = (F.col("_n") - 1) * F.get(F.array(*[F.lit(p) for p in ps]), F.col("_i"))

    def covers(pos: Column) -> Column:
        return (F.col("_to") - F.col("_c") <= pos) & (pos < F.col("_to"))

    read = ranked.withColumn("_at", at)
    aggs = []
    for i, name in enumerate(names):
        mine = F.col("_i") == i
        for side, pos in (("l", F.floor("_at")), ("h", F.ceil("_at"))):
            aggs.append(F.max(F.when(mine & covers(pos), F.col("_x"))).alias(f"_{side}{i}"))
        aggs.append(F.max(F.when(mine, F.col("_at") - F.floor("_at"))).alias(f"_f{i}"))
    found = read.groupBy(*keys).agg(*aggs)
    out = bounds.select(*keys, "_n").join(renamed_keys(found, keys, "_q", [c for c in found.columns if c not in keys]), same_group(keys, "_q"), "left")
    missed = F.raise_error(F.lit("a sketch's bounds missed a quantile")).cast("double")
    cols = []
    for i, name in enumerate(names):
        low, high = F.col(f"_l{i}").cast("double"), F.col(f"_h{i}").cast("double")
        cols.append(F.when(F.col("_n") == 0, F.lit(None).cast("double")).when(low.isNull() | high.isNull(), missed)
                    .otherwise(low + F.col(f"_f{i}") * (high - low)).alias(name))
    return out.select(*keys, *cols)
