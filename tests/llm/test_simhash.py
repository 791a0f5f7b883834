import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wattframe.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, errors=3):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(fps, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= errors:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def near_texts(n, seed=1):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    texts = []
    while len(texts) < n:
        base = [r.choice(words) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(r.randint(0, 2)):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t) if r.random() < 0.9 else "\t".join(t).upper())
    return texts[:n]


def test_fingerprint_equals_brute_force():
    for t in ["", " \n", "a", "a b", "A b\tC", "é ÀB x y", *near_texts(40)]:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("errors", [0, 1, 3, 5])
def test_trie_links_connect_exactly_the_near_pairs(errors):
    r = np.random.default_rng(errors)
    center = r.integers(0, 1 << 20, 40)
    keys = np.unique(np.concatenate([center, *[center ^ (1 << r.integers(0, 20, 40)) ^ (1 << r.integers(0, 20, 40)) for _ in range(8)]])).astype(np.uint64)
    groups = np.zeros(len(keys), np.int64)
    root = simhash.spanning(len(keys), simhash.trie_links(keys, groups, 20, errors))
    want = slow_components({i: int(k) for i, k in enumerate(keys)}, errors)
    assert [want[i] for i in range(len(keys))] == root.tolist()


def test_groups_are_not_linked_with_each_other():
    keys = np.array([5, 5, 7], np.uint64)
    root = simhash.spanning(3, simhash.trie_links(keys, np.array([0, 1, 1]), 8, 3))
    assert root.tolist() == [0, 1, 1]


@pytest.mark.parametrize("limit", [100_000, 7])
def test_components_equal_brute_force(spark, limit):
    texts = [*near_texts(150), None, "", "  ", "same", "same"]
    df = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    rows = simhash.near_duplicates(df, limit=limit).collect()
    fps = {i * 3: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp % (1 << 64) for r in rows} == fps
    assert {r.doc_id: r.component for r in rows} == slow_components(fps)


def test_dense_ball_and_chain(spark):
    # 300 fingerprints within 2 bits of one, and a chain of single steps: one component each
    r = random.Random(5)
    ball = {0x0F0F << 40} | {(0x0F0F << 40) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)}
    chain, x = [], (1 << 64) - 1
    for b in range(0, 40):
        chain.append(x)
        x ^= 1 << b
    fps = {i: f for i, f in enumerate([*ball, *chain])}
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    nodes = spark.createDataFrame(signed, "id long, fp long")
    got = {row.id: row.component for row in simhash.components(simhash.links(nodes)).collect()}
    want = slow_components(fps)
    assert {i: got.get(i, i) for i in fps} == want


def test_drop_keeps_one_of_each_group_and_rows_without_identifier(spark):
    long = " ".join("w%d" % i for i in range(80))
    df = spark.createDataFrame([(1, long, "a", 1), (2, long, "b", 2), (1, long, "a", 1), (3, "other words here entirely", "c", 3),
                                (None, long, "d", 4), (4, None, None, None), (5, "", "e", 0)],
                               "doc_id long, text string, component string, _salt int")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.component or "") for r in got.collect())
    assert rows == [(False, 1, "a"), (False, 3, "c"), (False, 4, ""), (True, 0, "d")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0
