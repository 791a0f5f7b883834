"""Global ranks, positions and exact quantiles without a single-task window.

An unpartitioned window (``rank() OVER (ORDER BY v)``) runs in one task.
Instead, rows are dealt out by range (``repartitionByRange``) on the group and
the value, so every bucket holds about as many rows as any other whatever the
values are, and Spark chooses the number of buckets by size. The ranged rows
are checkpointed: the number of a row's partition is then its bucket, the same
in every job and after a lost executor. Each bucket is ranked by its own window;
bucket offsets come from a small count table. Equal values always share a
bucket, so ties are handled exactly.

Before ranking, rows are reduced to distinct (group, value) with a count, so
a hot value or a hot group costs one row per distinct value, not one per row,
and it is these distinct rows that the buckets balance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.session import ensure_checkpoint_dir

#: rows that a task counts, sorts or ranks, about: nearly every value may be a new one, so its
#: memory follows its rows, whatever the size of a file split or the number of shuffle partitions
TASK_ROWS = 300_000


def by_range(df: DataFrame, order_cols: Sequence[str], n_buckets: int | None = None, out: str = "_b",
             freeze: bool = True) -> DataFrame:
    """The rows in range partitions of ``order_cols``, with their partition's number
    in ``out`` (ascending with the order).  They are checkpointed unless ``freeze`` is
    off, which is right only where a plan reads them once."""
    ranged = df.repartitionByRange(*([n_buckets] if n_buckets else []), *[F.col(c) for c in order_cols])
    if freeze:
        ensure_checkpoint_dir(df.sparkSession)
        ranged = ranged.checkpoint(eager=True)
    return ranged.withColumn(out, F.spark_partition_id())


def _offsets(totals: DataFrame, g: Sequence[str], size: str) -> DataFrame:
    """Add ``_off`` (rows of the group in earlier buckets) and ``_n`` (all of them)."""
    w_off = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return (totals.withColumn("_off", F.coalesce(F.sum(size).over(w_off), F.lit(0)))
            .withColumn("_n", F.sum(size).over(Window.partitionBy(*g))))


def _counts_by_parts(df: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Distinct keys with their count ``n_c``: counted in ``parts`` shares of the rows, then in
    as many shares of the keys. A hot key is at most a row per share and tag."""
    tagged = df.select(*keys).withColumn("_tag", F.pmod(F.monotonically_increasing_id(), F.lit(8 * parts))).repartition(parts, "_tag")
    shares = tagged.groupBy("_tag", *keys).agg(F.count(F.lit(1)).alias("_n1"))
    return shares.repartition(parts, *keys).groupBy(*keys).agg(F.sum("_n1").alias("n_c"))


def value_counts_ranked(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                        n_buckets: int | None = None, carry_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct (group, value) with ``n_ties``, ``cum_before`` (rows of the group
    with a smaller value), ``mid_rank`` (average 1-based rank of the ties) and
    ``n_group``.  NULL values are left out.

    With ``carry_cols`` the rows stay split by those columns (one row per
    (group, carry, value) with its own count ``n_c``) while ranks and ties are
    over the whole group - what a rank-sum test needs, without a join back."""
    g, carry = list(group_cols), list(carry_cols)
    base = df.where(F.col(value_col).isNotNull())
    parts = max(1, -(-base.count() // TASK_ROWS))
    counts = by_range(_counts_by_parts(base, [*g, *carry, value_col], parts), [*g, value_col], n_buckets or 4 * parts)
    counts = counts.repartition(parts, *g, "_b")  # some whole buckets to a task, as the windows want them
    w_upto = Window.partitionBy(*g, "_b").orderBy(value_col).rangeBetween(Window.unboundedPreceding,
                                                                          Window.currentRow)
    counts_ranked = (counts.withColumn("_upto", F.sum("n_c").over(w_upto))
                     .withColumn("n_ties", F.sum("n_c").over(Window.partitionBy(*g, "_b", value_col))))
    totals = _offsets(counts.groupBy(*g, "_b").agg(F.sum("n_c").alias("_bt")), g, "_bt").drop("_bt")
    out = _join_buckets(counts_ranked, totals, g)
    cum = (F.col("_off") + F.col("_upto") - F.col("n_ties")).cast("long")
    out = (out.withColumn("cum_before", cum)
           .withColumn("mid_rank", F.col("cum_before") + (F.col("n_ties") + F.lit(1)) / F.lit(2.0)))
    keep = [*g, *carry, value_col]
    if carry:
        keep.append(F.col("n_c").cast("long").alias("n_c"))
    return out.select(*keep, F.col("n_ties").cast("long").alias("n_ties"), "cum_before", "mid_rank",
                      F.col("_n").cast("long").alias("n_group"))


def _join_buckets(rows: DataFrame, totals: DataFrame, g: Sequence[str]) -> DataFrame:
    """Rows with the row of their (group, bucket), NULL groups included."""
    right = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("_b").alias("_tb"),
                          *[c for c in totals.columns if c not in (*g, "_b")])
    on = F.col("_b") == F.col("_tb")
    for i, c in enumerate(g):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(right, on, "inner").drop("_tb", *[f"_g{i}" for i in range(len(g))])


def exact_quantiles(df: DataFrame, value_col: str, probs: dict[str, float],
                    group_cols: Sequence[str] = (), n_buckets: int | None = None,
                    counts: DataFrame | None = None) -> DataFrame:
    """Exact quantiles by linear interpolation (R type 7, DuckDB ``quantile_cont``).

    ``probs`` maps output column name -> probability.  The distinct values of a
    group are counted and dealt out by range; bucket totals locate the buckets that
    hold the wanted positions, and only the values of those are ranked.  No group's
    values are ever held together.  A group without any value gives NULLs.
    ``counts`` may pass the ranged value counts (``value_counts``) if others use them.
    """
    g = list(group_cols)
    vals = value_counts(df, value_col, g, n_buckets) if counts is None else counts
    present = vals.where(F.col(value_col).isNotNull())
    bc = _offsets(present.groupBy(*g, "_b").agg(F.sum("n_c").alias("_c")), g, "_c")

    def positions(n):
        out = []
        for p in probs.values():
            h = (n - 1) * F.lit(float(p))
            out += [F.floor(h), F.ceil(h)]
        return out

    def covers(pos, start, count):
        return (start <= pos) & (pos < start + count)

    need = F.lit(False)
    for pos in positions(F.col("_n")):
        need = need | covers(pos, F.col("_off"), F.col("_c"))
    wanted = bc.where(need).select(*g, "_b", "_off", "_n")          # <= 2 buckets per probability and group
    near = _join_buckets(present, wanted, g)
    w_in = Window.partitionBy(*g, "_b").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_cum", F.col("_off") + F.coalesce(F.sum("n_c").over(w_in), F.lit(0)))
    aggs = [F.first("_n").alias("_n")]
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        for tag, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            aggs.append(F.max(F.when(covers(pos, F.col("_cum"), F.col("n_c")), F.col(value_col)))
                        .alias(f"_{tag}_{name}"))
    q = near.groupBy(*g).agg(*aggs)
    cols = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        frac = h - F.floor(h)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + frac * (hi - lo)).alias(name))
    out = q.select(*[F.col(c) for c in g], *cols)
    # groups that hold NULLs only
    absent = (vals.groupBy(*g).agg(F.max(value_col).alias("_m")).where(F.col("_m").isNull())
              .select(*g, *[F.lit(None).cast("double").alias(n) for n in probs]))
    return out.unionByName(absent) if g else out


def value_counts(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """Distinct (group, value) with ``n_c`` rows each, NULL values included, dealt out
    by range, checkpointed, with the bucket in ``_b``."""
    g = list(group_cols)
    return by_range(df.groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("n_c")), [*g, value_col], n_buckets)


def hash_positions(df: DataFrame, hash_col: str, tiebreak_cols: Sequence[str],
                   partition_cols: Sequence[str] = (), bucket_bits: int = 16) -> DataFrame:
    """0-based ``position`` of each row inside its partition when ordered by
    (hash, tie-break).  ``hash_col`` holds values in [0, 2^32).  Rows are
    windowed per (partition, top ``bucket_bits`` of the hash); with a unique
    key the hash spreads rows evenly over the buckets."""
    p = list(partition_cols)
    shift = 32 - bucket_bits
    b = df.withColumn("_hb", F.shiftright(F.col(hash_col), shift))
    counts = b.groupBy(*p, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    w_off = Window.partitionBy(*p).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w_off), F.lit(0))).drop("_c")
    w_row = Window.partitionBy(*p, "_hb").orderBy(F.col(hash_col), *[F.col(c) for c in tiebreak_cols])
    b = b.withColumn("_rn", F.row_number().over(w_row))
    return (b.join(offs, on=[*p, "_hb"], how="inner")
            .withColumn("position", (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_hb", "_off", "_rn"))


def ordered_positions(df: DataFrame, order_cols: Sequence[str], partition_cols: Sequence[str] = (),
                      n_buckets: int | None = None) -> DataFrame:
    """0-based ``position`` inside each partition ordered by ``order_cols``, NULLs
    first.  Rows that agree in all order columns are told apart by their place in
    the input, so that they need not share a bucket."""
    p = list(partition_cols)
    order = [*order_cols, "_tie"]
    b = by_range(df.withColumn("_tie", F.monotonically_increasing_id()), [*p, *order], n_buckets)
    offs = _offsets(b.groupBy(*p, "_b").agg(F.count(F.lit(1)).alias("_c")), p, "_c").drop("_c", "_n")
    w_row = Window.partitionBy(*p, "_b").orderBy(*[F.col(c) for c in order])
    b = b.withColumn("_rn", F.row_number().over(w_row))
    return (_join_buckets(b, offs, p)
            .withColumn("position", (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_b", "_off", "_rn", "_tie"))
