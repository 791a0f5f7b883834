"""Keyed permutations and the batches made of them."""

import pytest
from pyspark.sql import functions as F

from wattframe.operators import permute, split


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 20_011])
def test_bijection_for_every_key(spark, n):
    rows = spark.range(n)
    keys = [permute.round_keys(7, e) for e in range(3)]
    out = rows.select(*[permute.permuted(F.col("id"), n, F.array(*[F.lit(k).cast("long") for k in ks])).alias(f"p{i}") for i, ks in enumerate(keys)])
    columns = list(zip(*[tuple(r) for r in out.collect()]))
    assert all(sorted(c) == list(range(n)) for c in columns)
    if n >= 1000:
        assert len(set(columns)) == 3
        moved = [abs(a - b) for c in columns for a, b in enumerate(c)]
        assert 0.28 < sum(moved) / len(moved) / n < 0.38          # a third, as for a random order
        near = [abs(c[i] - c[i + 1]) for c in columns for i in range(n - 1)]
        assert 0.28 < sum(near) / len(near) / n < 0.38


def test_very_large_domains_stay_inside(spark):
    n = 2**59 + 12345
    at = [0, 1, 2, n // 2, n - 2, n - 1]
    df = spark.createDataFrame([(x,) for x in at], "x long")
    out = [r[0] for r in df.select(permute.permuted(F.col("x"), n, F.array(*[F.lit(k).cast("long") for k in permute.round_keys(1, 0)]))).collect()]
    assert len(set(out)) == len(at) and all(0 <= x < n for x in out)


def test_batches_of_each_epoch(spark):
    df = spark.range(1003).select((F.col("id") % 400).alias("k"), "id").repartition(5)       # keys that repeat
    got = split.shuffled_batches(df, ["k"], 10, 4, tiebreak_cols=["id"]).collect()
    again = split.shuffled_batches(df.repartition(3), ["k"], 10, 4, tiebreak_cols=["id"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    sizes, seen = {}, {}
    for r in got:
        sizes[r["epoch"], r["batch"]] = sizes.get((r["epoch"], r["batch"]), 0) + 1
        seen.setdefault(r["epoch"], []).append(r["id"])
    assert all(sorted(ids) == list(range(1003)) for ids in seen.values()) and len(seen) == 4
    assert sorted(sizes.values()) == [3] * 4 + [10] * 400
    assert len({tuple(sorted(r["id"] for r in got if (r["epoch"], r["batch"]) == (e, 0))) for e in range(4)}) == 4


def test_no_shuffle_of_rows_times_epochs(spark):
    plan = split.shuffled_batches(spark.range(100).withColumnRenamed("id", "k"), ["k"], 10, 50)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Exchange" not in above and "Window" not in above


def test_empty_table(spark):
    assert split.shuffled_batches(spark.range(0).withColumnRenamed("id", "k"), ["k"], 10, 2).collect() == []
