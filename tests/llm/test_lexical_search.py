"""Pair-bound MaxScore against exhaustive scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k=10):
    found = [(key, terms(text)) for key, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df, out = Counter(t for _, ts in found for t in set(ts)), []
    for q, text in queries:
        scored = []
        for key, ts in found:
            m = 10 + 90 * len(ts) * n_docs // max(n_terms, 1)
            s = 0
            for t in set(terms(text)):
                tf = ts.count(t)
                if tf:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, key is not None, key or 0))
        out += [(q, i + 1, key if known else None, -s) for i, (s, known, key) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, queries, **settings):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, `key` string, `a.b` int").repartition(4)
    q = spark.createDataFrame([(*r, "y") for r in queries], "item_id long, text string, row string")
    return L.search(L.build(d, F.col("doc_id")), q, F.col("item_id"), **settings)


def result(df):
    return sorted([(r.query, r.rank, r.key, r.score) for r in df.collect()], key=str)


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)] + ["É", "straße", "日本", "x_y", "A1"]
    weights = [1 / (i + 1) for i in range(len(names))]
    return [(i, " ".join(rng.choices(names, weights, k=rng.randrange(1, 80)))) for i in range(n)]


def test_terms_are_those_of_the_pattern():
    every = "".join(chr(c) for c in range(0x250)) + "日本語 ÀB_c-D e\U0001f600"
    assert [t.decode() for t in L.terms_of(every.encode())] == terms(every)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_DOCS", 90)
    monkeypatch.setattr(L, "RANGE", 16)
    docs, queries = corpus(seed, 500), corpus(seed + 10, 25)
    assert result(run(spark, docs, queries)) == brute(docs, queries)


def test_odd_rows(spark):
    docs = corpus(3, 80) + [(None, "w1 w50"), (200, None), (201, ""), (202, "., !"), (203, "w50 " * 40_000), (3, "w50 w51"), (3, "w50 w51")] + [
        (300 + i, "same copy w59") for i in range(40)]
    queries = [(1, "w50 W51 w59"), (1, "w50 W51 w59"), (2, None), (3, "."), (4, "unknown"), (None, "w1"), (5, "same copy"), (6, "w7 " * 3000)]
    assert result(run(spark, docs, queries)) == brute(docs, queries)


def test_chunks_of_queries(spark):
    docs, queries = corpus(4, 120), corpus(14, 12)
    assert result(run(spark, docs, queries, chunk_bytes=500, k=3)) == brute(docs, queries, 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "w1")]).collect() == []
    assert run(spark, [(1, "w1")], []).collect() == []
    assert run(spark, [(1, None)], [(1, "w1")]).collect() == []


def block_of(docs, queries):
    found = [(k, L.terms_of(t.encode())) for k, t in docs]
    asked = [(i, L.terms_of(t.encode())) for i, (_, t) in enumerate(queries)]
    df = {}
    for _, ts in found:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    chunk = L.Chunk(asked, df, len(found), sum(len(t) for _, t in found))
    return L.Block(L._postings([t.encode() for _, t in docs]), chunk), chunk


def test_pair_bounds_hold_and_are_tighter_than_single_ones(monkeypatch):
    monkeypatch.setattr(L, "RANGE", 32)
    docs, queries = corpus(7, 1500, 200), corpus(8, 40, 200)
    block, chunk = block_of(docs, queries)
    joint = {}
    for (a, b), number in chunk.pairs.items():
        d, s = block.intersection(a, b)
        joint[number] = block.range_maxima(d, s)
    read_single = read_pairs = 0
    for _, q in chunk.queries:
        pair = block.bounds(q, joint, chunk.pairs)
        single = [sum((block.postings(t)[2] for t in q[i:]), np.zeros(block.n_ranges, np.int64)) for i in range(len(q) + 1)]
        for i in range(len(q) + 1):
            true = np.zeros(block.n, np.int64)
            for t in q[i:]:
                d, s, _ = block.postings(t)
                true[d] += s
            assert (block.range_maxima(np.arange(block.n), true) <= pair[i]).all() and (pair[i] <= single[i]).all()
        a, b = block.top(q, single, 10, 0), block.top(q, pair, 10, 0)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        read_single, read_pairs = read_single + a[2], read_pairs + b[2]
    assert read_pairs < read_single < sum(len(block.postings(t)[0]) for _, q in chunk.queries for t in q)
