"""The path-copying Merkle manifest against a tree folded in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wattframe.llm import merkle_manifest as M


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes):
    """Root, and per leaf its siblings (before, after) level by level."""
    steps, at, row = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(row) > 1:
        for i, p in enumerate(at):
            first = p // 8 * 8
            steps[i].append(("".join(row[first:p]), "".join(row[p + 1 : first + 8])))
            at[i] = p // 8
        row = [H("".join(row[i : i + 8])) for i in range(0, len(row), 8)]
    return row[0], steps


def fold(node, steps):
    for before, after in steps:
        node = H(before + node + after)
    return node


def brute(rows):
    """rows: (key, group, text, changed?) -> sorted result tuples."""
    groups = {}
    for key, group, text, hit in rows:
        new = leaf((key, group, text.lower() if text is not None else None))
        groups.setdefault(group, []).append(((key is not None, key or 0), leaf((key, group, text)), key, new if hit else None))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:2])
        trees[g] = climb([x[1] for x in groups[g]])
    root, upper = climb([trees[g][0] for g in names])
    out = []
    for i, g in enumerate(names):
        subroot, steps = trees[g]
        for (_, h, key, new), own in zip(groups[g], steps):
            path = own + upper[i]
            out.append((key, g, h, subroot, root, H("".join(a + b for a, b in path)), new, fold(new or h, path)))
    return sorted(out, key=str)


def run(spark, rows, schema="key long, grp string, text string, hit boolean, `a.b` int, hash string", **settings):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(3)
    plain = [F.col("key"), F.col("grp"), F.col("text")]
    changed = [*plain[:2], F.lower("text")]
    return M.manifest(df, "key", "grp", plain, changed, F.coalesce(F.col("hit"), F.lit(False)), **settings)


def result(df):
    return sorted([(r.key, r.group, r.leaf, r.subroot, r.root, r.proof, r.changed_leaf, r.folded_root) for r in df.collect()], key=str)


@pytest.mark.parametrize("n", [1, 8, 9, 513])
def test_one_group(spark, n):
    rows = [(i, "g", f"Text {i}", i % 3 == 0) for i in range(n)]
    assert result(run(spark, rows)) == brute(rows)


def test_groups_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "B", "é", "zz"]), rng.choice([None, "", "Abc", "abc", "Ünï X"]), rng.random() < 0.5)
            for _ in range(400)]
    rows += [(1, f"lone {i}", "X", True) for i in range(70)] + [(3, "a", "Same", True)] * 30 + [(4, "a", "Long " * 100_000, True)]
    # equal leaves may be told apart by `hit` only: compare without the place of a tie
    got, want = result(run(spark, rows)), brute(rows)
    ties = {}
    for r in want:
        ties.setdefault((r[1], r[2]), []).append(r)
    unique = {k for k, v in ties.items() if len(v) == 1}
    assert len(got) == len(want) == len(rows)
    assert [r for r in got if (r[1], r[2]) in unique] == [r for r in want if (r[1], r[2]) in unique]
    assert {(r[1], r[3], r[4]) for r in got} == {(r[1], r[3], r[4]) for r in want}


def test_blocks_and_tiers_beyond_one(spark):
    """Blocks of 8 leaves, so that a small table has four tiers."""
    rows = [(i, "hot", f"Text {i}", i % 5 == 0) for i in range(700)] + [(i, f"g{i % 90}", None if i % 7 == 0 else f"T{i}", i % 2 == 0) for i in range(150)]
    assert result(run(spark, rows, height=1)) == brute(rows)


def test_versions_copy_ancestors_only(spark):
    rows = [(i, "g", f"Text {i}", i == 11) for i in range(100)]
    out = {r.key: r for r in run(spark, rows).collect()}
    assert [len(out[k].copied) for k in (10, 11)] == [0, 3]
    assert out[11].copied[-1] == out[11].folded_root != out[11].root
    assert all(r.folded_root == r.root for k, r in out.items() if k != 11)


def test_persistent_tree_shares_untouched_nodes():
    tree = M.PersistentTree([H(str(i)) for i in range(100)], M.levels_of(100))
    before = list(tree.hashes)
    one = tree.replace(42, H("new"))
    two = tree.replace(43, H("other"), one)
    assert tree.hashes[: len(before)] == before
    assert len(tree.hashes) == len(before) + 2 * (1 + tree.levels)
    want = [H(str(i)) for i in range(100)]
    want[42], want[43] = H("new"), H("other")
    assert tree.hashes[two] == climb(want)[0]
    assert sum(a == b for a, b in zip(tree.children[one], tree.children[tree.root])) == len(tree.children[one]) - 1
    tree.forget()
    assert tree.hashes == before


def test_empty_table(spark):
    assert run(spark, []).collect() == []
