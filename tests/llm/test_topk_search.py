import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wattframe.llm import topk_search

SF = "/root/testdata/sf0.1/embeddings.parquet"


def slow(rows, k, is_query, factor=64):
    ok = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ok.append((i, [int(np.floor(float(x) * factor)) for x in v]))
    out = []
    for i, q in ok:
        if is_query(i):
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "ties", "clusters"])
def test_equals_brute_force(spark, kind):
    r = np.random.default_rng(3)
    x = {"normal": r.normal(0, 0.2, (400, 8)), "ties": r.integers(-1, 2, (400, 8)) / 64.0,
         "clusters": np.repeat(r.normal(0, 1, (10, 8)), 40, axis=0)}[kind]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=20, query_block=7, candidate_block=90)
    assert sorted(tuple(z) for z in got.collect()) == slow(rows, 20, lambda i: i % 20 == 0)


def test_unusable_vectors_lengths_and_repeats(spark):
    rows = [(0, [0.5, 1.0]), (20, [0.5, -1.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 0.0]), (7, [1.0, 2.0, 3.0]), (40, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (1, [1.0, 1.0]), (60, [5.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=3)
    assert sorted(tuple(z) for z in got.collect()) == slow(rows, 3, lambda i: i % 20 == 0)


def test_large_components_are_exact(spark):
    rows = [(0, [2.0 ** 24, 1.0]), (1, [2.0 ** 24, 0.0]), (2, [2.0 ** 24, 1.0 / 64]), (3, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk_search.top_k(df, F.col("vec_id") == 0).collect()}
    assert got[2] - got[1] == 64 and got[3] == (1 << 63) - 1


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 1.0])
def test_bounds_hold(share):
    r = np.random.default_rng(1)
    for x in (np.round(r.normal(0, 8, (700, 16))), r.integers(-2, 3, (60, 5)).astype(float), np.zeros((9, 3))):
        lists = topk_search.SortedLists(x)
        q = np.round(r.normal(0, 8, (40, x.shape[1])))
        lower, upper, entries = lists.bounds(q, share)
        exact = q @ x.T
        assert (lower <= exact).all() and (exact <= upper).all() and entries <= x.size


@pytest.mark.skipif(not os.path.isfile(SF), reason="driver tables not present")
def test_reading_stops_before_the_lists_end_on_the_driver_vectors():
    table = pq.read_table(SF)
    x = np.floor(64.0 * np.array(table.column("embedding").to_pylist(), float))
    ids = np.array(table.column("vec_id").to_pylist())
    queries = np.flatnonzero(ids % 20 == 0)
    first, rest = topk_search.SortedLists(x[:500]), topk_search.SortedLists(x[500:])
    own = np.zeros((len(queries), len(x)), bool)
    own[np.arange(len(queries)), queries] = True
    lowest = np.full(len(queries), -np.inf)
    floors = np.array([np.sort(s)[-20] for _, _, s, _ in topk_search.block_best(x[queries], first, 20, own[:, :500], lowest)])
    read = left = 0
    for i, rows, _, entries in topk_search.block_best(x[queries], rest, 20, own[:, 500:], floors):
        read, left = read + entries, left + len(rows)
        best = np.argsort(-(rest.x @ x[queries[i]]) + 1e9 * own[i, 500:], kind="stable")[:20]
        assert set(best[rest.x[best] @ x[queries[i]] >= floors[i]]) <= set(rows)
    assert read < 0.85 * len(queries) * rest.x.size and left < 0.1 * len(queries) * rest.n


def test_text_identifiers_and_clashing_names(spark):
    r = np.random.default_rng(5)
    rows = [(f"v{i:03d}", [float(a) for a in v], 1, "x") for i, v in enumerate(r.normal(0, 0.2, (90, 6)))]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, row int, `a.b` string")
    got = topk_search.top_k(df, F.col("vec_id") < "v010", k=5, query_block=4, candidate_block=30)
    assert sorted(tuple(z) for z in got.collect()) == slow([x[:2] for x in rows], 5, lambda i: i < "v010")


def test_empty_table_and_no_query(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.col("vec_id") % 20 == 0).count() == 0
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.col("vec_id") % 20 == 0).count() == 0
