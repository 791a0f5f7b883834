"""Sharding by a hierarchical weighted hash tree.

A topology lists shards with their region, rack and weight. A document descends
region, rack, shard: at each node every child draws ln(u) / weight, u a hash of
the document's key and the child's name in (0, 1), and the largest draw wins. So
children get keys in proportion to their weights, and a child's draw depends on
nothing but its own name and weight: when weights change, keys move only between
the children of the nodes on the changed path, and the rest of the tree stays as
it is. A shard added as a region of its own takes keys only into itself.

Everything is expressions on the row. Slots (places inside a shard) come from
counts of hash buckets: rows are numbered within (shard, bucket), and the offsets
of the buckets from their counts, at most ``shards * SLOT_BUCKETS`` rows. Buckets
are dealt by row, so repeated rows or one hot key do not meet in one bucket.

Edge cases: a null key is hashed as the empty string, which no number gives; a
null text has size 8 and CRC 0; repeated rows go to the same shard with slots of
their own; an empty table gives an empty result. Columns of any name are carried as
they are; ``shard``, ``grown_shard`` and ``slot`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.common import frozen

SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def topology(n_shards: int, base: int = 24, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """Regions of ``racks * per_rack`` shards up to ``base`` shards; each further
    shard is a region of its own, so that growth moves rows only into it."""
    out = []
    for i in range(n_shards):
        if i < base:
            region = i // (racks * per_rack)
            out.append(Shard(i, f"r{region}", f"r{region}k{i // per_rack % racks}"))
        else:
            out.append(Shard(i, f"x{i}", f"x{i}k0"))
    return out


def _children(shards: Sequence[Shard]) -> list[dict[str, dict[str, float]]]:
    """For each level, parent -> child -> weight; a node weighs what is below it."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in shards:
        for level, parent, child in ((0, "root", s.region), (1, s.region, s.rack), (2, s.rack, str(s.number))):
            node = levels[level].setdefault(parent, {})
            node[child] = node.get(child, 0.0) + s.weight
    return levels


def draw(key: Column, child: Column, weight: Column) -> Column:
    """ln(u) / weight with u from the first 52 bits of an MD5 of key and child."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), child)), 1, 13), 16, 10).cast("double")
    return F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def _choose(key: Column, options: Column) -> Column:
    """The name of the child with the largest draw; equal draws go to the larger name."""
    drawn = F.transform(options, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_max(drawn)["name"]


def place(df: DataFrame, key: Column, shards: Sequence[Shard], out: str) -> DataFrame:
    """Add the integer column ``out``, the shard of each row."""
    name = F.coalesce(key.cast("string"), F.lit(""))
    node, steps = F.lit("root"), []
    for i, level in enumerate(_children(shards)):
        table = F.create_map(*[x for parent, kids in sorted(level.items()) for x in (
            F.lit(parent), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in sorted(kids.items())]))])
        df = df.withColumn(f"_{out}_{i}", _choose(name, F.element_at(table, node)))
        steps.append(f"_{out}_{i}")
        node = F.col(steps[-1])
    return df.withColumn(out, F.col(steps[-1]).cast("int")).drop(*steps)


def with_slots(df: DataFrame, shard_col: str = "shard", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Add ``slot``: 0, 1, 2 ... within each shard, without a gap. The rows are
    frozen first, so a row's bucket and its place are the same whenever they are read."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns if c != "slot"])
    numbered = df.select(row.alias("row"), F.col(shard_col).alias("home"), F.monotonically_increasing_id().alias("place"))
    rows = frozen(numbered.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)).cast("int")))
    counts = rows.groupBy("home", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("home").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # names of its own: both sides of the join come from one table
    offsets = frozen(counts.select(F.col("home").alias("of"), F.col("bucket").alias("of_bucket"),
                                   F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before")))
    rank = F.row_number().over(Window.partitionBy("home", "bucket").orderBy("place"))
    # one row for each shard and bucket: bounded by the topology
    out = rows.withColumn("rank", rank).join(F.broadcast(offsets), F.col("home").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket")))
    return out.select("row.*", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))


def shard_rows(df: DataFrame, key_col: str, n_shards: int, base: int | None = None) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one more shard) and ``slot``."""
    base = n_shards if base is None else base
    kept = [c for c in df.columns if c not in ("shard", "grown_shard", "slot")]
    placed = df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in kept]).alias("row"), F.col(f"`{key_col}`").alias("key"))
    placed = place(placed, F.col("key"), topology(n_shards, base), "shard")
    placed = place(placed, F.col("key"), topology(n_shards + 1, base), "grown")
    return with_slots(placed.select("row.*", "shard", F.col("grown").alias("grown_shard")))
