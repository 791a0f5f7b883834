"""Merkle manifest of a table as a persistent path-copying tree.

A row's leaf is the SHA-256 of its fields. Per group (``group_col``) the leaves in
key order, and then the groups' roots, go up an 8-ary tree: every 8 consecutive
nodes (the last run may be shorter, even one) become their hash while more than
one node is left. Digests are hashed as hex text, joined.

A changed row does not rebuild the tree. It makes a version of it: the ancestors
of its leaf are copied with one child replaced, all other nodes are shared with
the original version. The tree is cut into aligned blocks of 8^4 leaves. A block
is built once, as an arena of nodes; a version copies four nodes of it. Block
roots are the leaves of the next tier of blocks, in which the versions continue:
a block hands its rows the nodes beside its own path there. So the nodes above a
block are shared by all its versions too, and each tier has 4096 times fewer.

Leaves are numbered by range partitions of (group, key), so a group holding most
rows is as well dealt out as any other; then rows meet by (group, block), 4096 at
most. No tree, group or level is ever in one task, whatever the number of groups.

Edge cases: null keys come first in their group; the null group is one and comes
first; equal keys are in order of their leaves (equal rows have equal leaves, and
any order of them gives the same hashes); a null field is hashed as ``-``, an empty
text as ``0:``; a row without siblings has the hash of the empty text as proof; an
empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm.common import frozen
from wattframe.operators import ranking

FANOUT = 8
HEIGHT = 4  # levels of a block: 8 ** 4 leaves


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n = -(-n // FANOUT)
        levels += 1
    return levels


def leaf(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each as its UTF-8 length, a colon and its text."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


class PersistentTree:
    """Nodes in an arena; a version is the index of its root. Nodes never change."""

    def __init__(self, leaves: Sequence[str], levels: int):
        self.hashes: list[str] = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._node(tuple(row[i : i + FANOUT])) for i in range(0, len(row), FANOUT)]
        self.levels, self.root, self.base = levels, row[0], len(self.hashes)

    def _node(self, children: tuple[int, ...]) -> int:
        self.children.append(children)
        self.hashes.append(digest([self.hashes[c] for c in children]))
        return len(self.hashes) - 1

    def path(self, position: int, root: int | None = None) -> list[int]:
        """Nodes of a version from its root down to the leaf at ``position``."""
        out = [self.root if root is None else root]
        for level in range(self.levels - 1, -1, -1):
            out.append(self.children[out[-1]][position // FANOUT**level % FANOUT])
        return out

    def replace(self, position: int, leaf_hash: str, root: int | None = None) -> int:
        """The root of a new version with another leaf: its ancestors are copied."""
        *ancestors, _ = self.path(position, root)
        self.children.append(())
        self.hashes.append(leaf_hash)
        node = len(self.hashes) - 1
        for level, ancestor in enumerate(reversed(ancestors)):
            kids = list(self.children[ancestor])
            kids[position // FANOUT**level % FANOUT] = node
            node = self._node(tuple(kids))
        return node

    def forget(self) -> None:
        """Drop the nodes that versions have added; the original version stays."""
        del self.hashes[self.base :], self.children[self.base :]

    def steps(self, position: int) -> list[tuple[str, str]]:
        """Per level, from the leaf up: the siblings before and after the path."""
        path = self.path(position)
        out = []
        for level in range(self.levels):
            kids, at = self.children[path[-2 - level]], position // FANOUT**level % FANOUT
            out.append(("".join(self.hashes[c] for c in kids[:at]), "".join(self.hashes[c] for c in kids[at + 1 :])))
        return out


STEP = "struct<before:string,after:string>"
ARROW_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _levels_of(n: str) -> Column:
    """``levels_of`` as an expression: comparisons with the powers of the fanout."""
    return F.expr(" + ".join(f"cast({n} > {FANOUT**k} as int)" for k in range(21)))


def _block_tree(rows: pa.Table, tier: int, height: int) -> PersistentTree:
    """The tree of a block of this tier; ``rows`` are its nodes, in order."""
    return PersistentTree(rows["hash"].to_pylist(), min(height, levels_of(rows["n"][0].as_py()) - tier * height))


def _in_blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"position div {FANOUT**height}"))


def _with_tops(nodes: DataFrame, blocks: DataFrame, height: int):
    """The nodes of each block beside the row of ``blocks`` (gid, block, steps, subroot,
    root) for it. The columns there are new ones: both sides may come from one table."""
    tops = blocks.select(F.col("gid").alias("top_gid"), F.col("block").alias("top_block"),
                         *[F.col(c).alias(c) for c in ("steps", "subroot", "root")])
    return _in_blocks(nodes, height).groupBy("gid", "block").cogroup(tops.groupBy("top_gid", "top_block"))


def _block_roots(nodes: DataFrame, tier: int, height: int) -> DataFrame:
    """The next tier: a row for each block of ``nodes``."""
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        tree = _block_tree(rows, tier, height)
        return pa.table({"gid": rows["gid"][:1], "position": rows["block"][:1], "hash": [tree.hashes[tree.root]], "n": rows["n"][:1]})

    return _in_blocks(nodes, height).groupBy("gid", "block").applyInArrow(build, "gid long, position long, hash string, n long")


def _tiers(nodes: DataFrame, most: int, height: int) -> list[DataFrame]:
    """``nodes`` (gid, position, hash, n: leaves of the group) and the tiers above, until
    each group has come down to one node."""
    tiers = [nodes]
    while levels_of(most) > (len(tiers) - 1) * height:
        tier = len(tiers) - 1
        tiers.append(frozen(_block_roots(tiers[-1].where(_levels_of("n") > tier * height), tier, height)))
    return tiers


def _roots(tiers: list[DataFrame], height: int) -> DataFrame:
    """(gid, hash): the root of each group, in the tier in which its levels end."""
    out = None
    for tier, nodes in enumerate(tiers):
        done = nodes.where(_levels_of("n") <= tier * height).select("gid", "hash")
        out = done if out is None else out.unionByName(done)
    return out


def _paths(nodes: DataFrame, above: DataFrame, tier: int, height: int) -> DataFrame:
    """For each node the siblings on its way up; ``above`` has that of its block."""
    def run(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        tree, upper = _block_tree(rows, tier, height), top["steps"][0].as_py()
        steps = [[{"before": a, "after": b} for a, b in tree.steps(i)] + upper for i in range(len(rows))]
        return pa.table({"gid": rows["gid"], "position": rows["position"], "steps": pa.array(steps, ARROW_STEPS),
                         "subroot": [top["subroot"][0].as_py()] * len(rows), "root": [top["root"][0].as_py()] * len(rows)})

    return _with_tops(nodes, above.withColumnRenamed("position", "block"), height).applyInArrow(
        run, f"gid long, position long, steps array<{STEP}>, subroot string, root string")


def _paths_down(tiers: list[DataFrame], tops: DataFrame, lowest: int, height: int) -> DataFrame | None:
    """(gid, position, steps, subroot, root) of the nodes of tier ``lowest``. ``tops`` has
    (gid, steps, subroot, root): what is above the groups' roots."""
    above = None
    for tier in range(len(tiers) - 1, lowest - 1, -1):
        levels = _levels_of("n")
        found = tiers[tier].where(levels <= tier * height).select("gid", "position").join(tops, "gid").select(
            "gid", "position", "steps", "subroot", "root")
        if above is not None:
            found = found.unionByName(_paths(tiers[tier].where(levels > tier * height), above, tier, height))
        above = frozen(found)
    return above


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``gid`` (the place of their group among the groups), ``position`` in it
    and ``n``, its rows; and the groups (gid, grp)."""
    order = ["key", "hash", "_tie"]
    rows = ranking.by_range(leaves.withColumn("_tie", F.monotonically_increasing_id()), ["grp", *order])
    earlier = Window.partitionBy("grp").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (rows.groupBy("grp", "_b").agg(F.count(F.lit(1)).alias("c"))
               .select("grp", "_b", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"),
                       F.sum("c").over(Window.partitionBy("grp")).alias("n")))
    buckets = frozen(buckets)
    groups = frozen(ranking.ordered_positions(buckets.select("grp").distinct(), ["grp"]).withColumnRenamed("position", "gid"))
    places = buckets.alias("b").join(groups.alias("g"), F.col("b.grp").eqNullSafe(F.col("g.grp"))).select(
        F.col("b.grp").alias("pgrp"), F.col("_b").alias("pb"), "before", "n", "gid")
    rank = F.row_number().over(Window.partitionBy("grp", "_b").orderBy(*order))
    # a bucket is a range partition: no group's rows meet in one
    numbered = rows.withColumn("_rank", rank).join(places, (F.col("_b") == F.col("pb")) & F.col("grp").eqNullSafe(F.col("pgrp")))
    return frozen(numbered.select("gid", (F.col("before") + F.col("_rank") - 1).cast("long").alias("position"), "hash",
                                  F.col("n").cast("long").alias("n"), "key", "changed")), groups


def manifest(df: DataFrame, key_col: str, group_col: str, fields: Sequence[Column], changed: Sequence[Column],
             when: Column, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``df``: key, group, position in the group, leaf, subroot (the
    group's root), root, proof (hash of all siblings up to the root), changed_leaf (of
    the fields ``changed``; null unless ``when`` holds), copied (the hashes of the
    copied ancestors, from the leaf up) and folded_root (of the row's version; of a row
    without one, the root folded again from its leaf)."""
    # texts are hashed once
    leaves = frozen(df.select(F.col(key_col).alias("key"), F.col(group_col).alias("grp"), leaf(fields).alias("hash"),
                              F.when(when, leaf(changed)).alias("changed")))
    rows, groups = _numbered(leaves)
    nodes = rows.select("gid", "position", "hash", "n")
    facts = rows.agg(F.max("n"), F.max("gid")).first()
    most, n_groups = facts[0] or 1, (facts[1] or 0) + 1
    tiers = _tiers(nodes, most, height)

    # the groups' roots are the leaves of one more tree, of a single group
    roots = _roots(tiers, height)
    upper = frozen(roots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("position"), "hash", F.lit(n_groups).cast("long").alias("n")))
    upper_tiers = _tiers(upper, n_groups, height)
    no_steps = F.expr(f"cast(array() as array<{STEP}>)")
    top = _roots(upper_tiers, height).select("gid", no_steps.alias("steps"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    group_paths = _paths_down(upper_tiers, frozen(top), 0, height).select(F.col("position").alias("gid"), "steps", "root")
    tops = frozen(group_paths.join(upper.select(F.col("position").alias("gid"), F.col("hash").alias("subroot")), "gid"))

    versions = _versions(rows, _block_paths(tiers, tops, height), height)
    return versions.join(groups, "gid").select("key", F.col("grp").alias("group"), *[c for c in versions.columns if c not in ("gid", "key")])


def _block_paths(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """What is above each block of leaves: the path of its node in tier 1, or, for a
    group of a single leaf, what is above the group's root."""
    lone = tiers[0].where("n = 1").select("gid", F.lit(0).cast("long").alias("block")).join(tops, "gid").select(
        "gid", "block", "steps", "subroot", "root")
    if len(tiers) == 1:
        return lone
    return lone.unionByName(_paths_down(tiers, tops, 1, height).withColumnRenamed("position", "block"))


def _versions(rows: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """The result rows: a version for each changed leaf, block by block."""
    text = T.StringType()
    schema = T.StructType([T.StructField("gid", T.LongType()), rows.schema["key"], T.StructField("position", T.LongType())])
    for name in ("leaf", "subroot", "root", "proof", "changed_leaf"):
        schema = schema.add(name, text)
    schema = schema.add("copied", T.ArrayType(text)).add("folded_root", text)

    def run(mine: pa.Table, top: pa.Table) -> pa.Table:
        mine = mine.sort_by("position")
        tree, upper = _block_tree(mine, 0, height), top["steps"][0].as_py()
        beside = [s["before"] + s["after"] for s in upper]
        proofs, copied, folded = [], [], []
        for i, (old, new) in enumerate(zip(mine["hash"].to_pylist(), mine["changed"].to_pylist())):
            proofs.append(digest([a + b for a, b in tree.steps(i)] + beside))
            version = tree.replace(i, old if new is None else new)
            path = [tree.hashes[x] for x in reversed(tree.path(i, version))]
            tree.forget()  # the version has been read
            for s in upper:
                path.append(digest([s["before"], path[-1], s["after"]]))
            folded.append(path[-1])
            copied.append([] if new is None else path[1:])
        return pa.table({"gid": mine["gid"], "key": mine["key"], "position": mine["position"], "leaf": mine["hash"],
                         "subroot": [top["subroot"][0].as_py()] * len(mine), "root": [top["root"][0].as_py()] * len(mine), "proof": proofs,
                         "changed_leaf": mine["changed"], "copied": pa.array(copied, pa.list_(pa.string())), "folded_root": folded})

    return _with_tops(rows, blocks, height).applyInArrow(run, schema)
