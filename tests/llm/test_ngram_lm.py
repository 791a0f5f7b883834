import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import ngram_lm, queries
from wattframe.llm.elias_fano import EliasFano


def is_train(key):
    return zlib.crc32(str(key).encode()) % 10 != 0


def brute(rows, order):
    """(n_tokens, n_known, N, base, score) for each row by dictionaries of n-grams."""
    toks = [((t or "").encode().lower().split() + [b"</s>"]) for _, t in rows]
    grams = [Counter() for _ in range(order + 1)]
    for (key, _), t in zip(rows, toks):
        if is_train(key):
            padded = [b"</s>", *t]
            grams[1].update((w,) for w in t)
            for n in range(2, order + 1):
                grams[n].update(tuple(padded[i - n + 1:i + 1]) for i in range(max(n - 1, 1), len(padded)))
    total, v = sum(grams[1].values()), len(grams[1])
    out = []
    for t in toks:
        padded, base, score = [b"</s>", *t], 0.0, 0.0
        for i in range(1, len(padded)):
            p = (grams[1][(padded[i],)] + 0.1) / (total + 0.1 * (v + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                if i - n + 1 < 0:
                    continue
                ctx = tuple(padded[i - n + 1:i])
                seen = grams[n - 1][ctx]
                mu = ngram_lm._mu(n)
                p = (grams[n][(*ctx, padded[i])] + mu * p) / (seen + mu)
            score += math.log10(p)
        out.append((len(t), sum(grams[1][(w,)] > 0 for w in t), total, base, score))
    return out


def texts(n, seed=0):
    r = random.Random(seed)
    words = ["a", "The", "b", "É", "é", "x,", "yy", "z", *("w%d" % i for i in range(60))]
    return [" ".join(r.choices(words, weights=[30, 20, 10, *[1] * (len(words) - 3)], k=r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("order,block,shard", [(2, 1 << 20, 1 << 20), (2, 200, 300), (3, 150, 400), (1, 100, 100)])
def test_equals_dictionaries(spark, order, block, shard):
    rows = [(i, t) for i, t in enumerate(texts(120))] + [(200, None), (201, ""), (202, " \t\n"), (203, "a a a " * 400), (7, "a The b")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, words string").repartition(3)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = ngram_lm.score(df, train, order=order, block_tokens=block, shard_tokens=shard).collect()
    want = sorted(zip([k for k, _ in rows], brute(rows, order)), key=lambda x: (x[0], x[1][0]))
    got = sorted(got, key=lambda r: (r.doc_id, r.n_tokens))
    assert [r.doc_id for r in got] == [k for k, _ in want]
    for r, (_, (n, known, total, base, score)) in zip(got, want):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, abs=n / ngram_lm.STEP)


def test_the_query_scores_by_trigrams(spark, tmp_path):
    rows = list(enumerate(texts(80, 2)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op2_ngram_lm"](spark, str(tmp_path)).collect()}
    for (k, _), (n, *_, score) in zip(rows, brute(rows, 3)):
        assert got[k].score == pytest.approx(score, abs=n / ngram_lm.STEP)


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    got = ngram_lm.score(df, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got) and len(got) == 2
    assert ngram_lm.score(df.limit(0), F.lit(True)).count() == 0


def test_elias_fano_get_and_successor(tmp_path):
    r = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 1), (1, 10**12), (1000, 1000), (1000, 10), (4000, 10**9), (3000, 2**50)):
        folder = tmp_path / f"{n}-{u}"
        folder.mkdir()
        v = np.sort(r.integers(0, u, n)).astype(np.uint64)
        e = EliasFano(str(folder), "x", v)
        assert (e.get(np.arange(n)) == v).all()
        q = np.concatenate([r.integers(0, u + 2, 500).astype(np.uint64), v])
        begin = r.integers(0, n + 1, len(q))
        end = np.minimum(n, begin + r.integers(0, 50, len(q)))
        want = [a + np.searchsorted(v[a:b], x) for x, a, b in zip(q, begin, end)]
        assert e.successor(q, begin, end).tolist() == want


def test_level_finds_exactly_its_pairs(tmp_path):
    r = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 50, 400), r.integers(0, 90, 400))})
    ctx, word = np.array(pairs).T
    ngram_lm.Level.build(str(tmp_path), "x", ctx, word)
    trie = ngram_lm.Level.load(str(tmp_path), "x")
    ask = np.array([(a, b) for a in range(52) for b in range(92)])
    place = trie.find(ask[:, 0], ask[:, 1])
    index = {p: i for i, p in enumerate(pairs)}
    assert place.tolist() == [index.get((int(a), int(b)), -1) for a, b in ask]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_a_stored_slice_finds_exactly_its_n_grams(tmp_path, order):
    r = np.random.default_rng(order)
    table = np.unique(r.integers(0, 9, (700, order)), axis=0)
    kept = r.random(len(table)) < 0.6
    total = r.integers(1, 300, int(kept.sum()))
    ngram_lm.Slice.build(str(tmp_path / "s"), table[kept], total, None, True)
    trie = ngram_lm.Slice.load(str(tmp_path / "s"))
    place = trie.find(table)
    assert (place >= 0).tolist() == kept.tolist()
    assert trie.counts[place[kept]].tolist() == total.tolist()
    seen = {}
    for g, t in zip(table[kept][:, :-1].tolist(), total.tolist()):
        seen[tuple(g)] = seen.get(tuple(g), 0) + t
    share = total / (np.array([seen[tuple(g)] for g in table[kept][:, :-1].tolist()]) + ngram_lm._mu(order))
    assert np.abs(10.0 ** (-trie.codes[place[kept]].astype(float) / ngram_lm.STEP) / share - 1).max() < 1e-3
    assert len(ngram_lm.Slice.build(str(tmp_path / "e"), table[:0], total[:0], None, False).find(table[:0])) == 0
    assert (ngram_lm.Slice.load(str(tmp_path / "e")).find(table) == -1).all()


def test_unseen_texts_are_scored_by_stored_slices(spark):
    rows = list(enumerate(texts(150, 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learned = F.col("doc_id") < 120
    scores, model = ngram_lm.learn_and_score(df, learned, block_tokens=300, shard_tokens=500)
    want = {r.doc_id: r for r in scores.collect()}
    got = {r.doc_id: r for r in ngram_lm.score_unseen(model, df.where("doc_id >= 120").repartition(2), block_tokens=200).collect()}
    assert set(got) == set(range(120, 150))
    for k, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (want[k].n_tokens, want[k].n_known, want[k].train_tokens, pytest.approx(want[k].base_score))
        assert r.score == pytest.approx(want[k].score, abs=1e-9)
    new = ngram_lm.score_unseen(model, spark.createDataFrame([(1, "never seen words"), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in new) == [(1, 4, 1), (2, 1, 1)]


@pytest.mark.parametrize("most", [5, 1 << 21, 1 << 40])
def test_rows_sorted_in_64_bits_and_packed(most):
    r = np.random.default_rng(most)
    table = np.concatenate([r.integers(0, most, (500, 3)), r.integers(0, 4, (500, 3))])
    by, new = ngram_lm._sorted(list(table.T))
    assert (table[by] == table[np.lexsort(table.T[::-1])]).all()
    assert (table[by][new] == np.unique(table, axis=0)).all()
    for rows in (table[by][new], table[:0]):
        assert (ngram_lm._unpack_grams(ngram_lm._pack_grams(rows)) == rows).all()


def test_a_token_is_asked_for_once(spark, tmp_path):
    rows = list(enumerate(texts(60, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    blocks = ngram_lm.blocks_of(docs, F.col("doc_id"), F.lit(True), str(tmp_path), block_tokens=300).localCheckpoint()
    asked = ngram_lm._asked(blocks.select("block", "name"), ngram_lm.vocabulary(blocks, 3).where("block >= 0"), str(tmp_path), 3, 3).collect()
    tokens = [len((t or "").split()) + 1 for _, t in rows]
    times = {k: sum(int(ngram_lm._unpack(r["times"]).sum()) for r in asked if r["order"] == k) for k in (2, 3)}
    assert times == {2: len(rows), 3: sum(tokens) - len(rows)}  # the first words have no longer n-gram


def test_one_trie_holds_the_shorter_n_grams(tmp_path):
    long = np.array([[1, 2, 0], [1, 2, 5], [4, 0, 3]])
    short = np.array([[1, 2], [1, 3], [4, 0]])
    counts = np.array([2, 300, 1]), np.array([302, 7, 1])
    ngram_lm.Slice.build(str(tmp_path / "s"), long, counts[0], None, True, False, {2: (short, counts[1])})
    trie = ngram_lm.Slice.load(str(tmp_path / "s"))
    assert trie.seen(np.array([[0, 2], [1, 2], [1, 3], [4, 0], [4, 1]])).tolist() == [0, 302, 7, 1, 0]
    assert trie.seen(np.array([[1, 2, 0], [1, 2, 1], [1, 3, 0], [4, 0, 3]])).tolist() == [2, 0, 0, 1]


def test_a_model_of_fourgrams_meets_longer_n_grams_than_it_learned(spark):
    rows = [(0, "a"), (1, "b a"), (2, "a b a b a"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores, model = ngram_lm.learn_and_score(df, F.col("doc_id") < 2, order=4, shard_tokens=2)
    want = {r.doc_id: r.score for r in scores.collect()}
    got = {r.doc_id: r.score for r in ngram_lm.score_unseen(model, df.where("doc_id > 1")).collect()}
    assert got == pytest.approx({k: want[k] for k in (2, 3)})
