"""rANS blocks, token-ID files and their queries against the tokenizers library and exact round trips."""

import glob
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from wattframe.llm import queries, range_coder, token_files
from wattframe.session import scratch_path

FILE = P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def table_of(ids):
    return range_coder.FrequencyTable.fit(*np.unique(ids, return_counts=True))


@pytest.mark.parametrize("n", [1, 2, 255, 256, 5000, 140_000])
@pytest.mark.parametrize("symbols", [1, 7, 3000])
def test_block_round_trip(n, symbols):
    rng = np.random.default_rng(n * symbols)
    ids = (rng.zipf(1.3, n) % symbols * 11).astype(np.uint32)
    table = table_of(ids)
    data = range_coder.encode_block(ids, table, every=16)
    assert np.array_equal(range_coder.decode_block(data, table), ids)
    for a, b in [(0, 1), (n // 3, n // 2 + 1), (n - 1, n), (n // 2, n // 2)]:
        assert np.array_equal(range_coder.decode_block(data, table, a, b), ids[a:b])


def test_block_is_near_its_entropy_and_shows_damage():
    rng = np.random.default_rng(1)
    ids = rng.choice(1000, 300_000, p=(lambda w: w / w.sum())(1 / np.arange(1, 1001))).astype(np.uint32)
    table = table_of(ids)
    data = range_coder.encode_block(ids, table)
    p = np.bincount(ids) / len(ids)
    assert len(data) * 8 < 1.06 * len(ids) * -(p * np.log2(p)).sum()
    damaged = bytearray(data)
    damaged[len(data) // 2] ^= 1
    with pytest.raises(range_coder.Corrupt):
        range_coder.decode_block(bytes(damaged), table)


def test_table_round_trip_and_rare_symbols():
    table = range_coder.FrequencyTable.fit(np.arange(70_000), np.r_[[10**12], np.ones(69_999)])
    assert table.freq.min() == 1 and table.freq.sum() == 1 << table.bits
    again = range_coder.FrequencyTable.from_bytes(table.to_bytes())
    assert np.array_equal(again.freq, table.freq) and np.array_equal(again.symbols, table.symbols)
    with pytest.raises(range_coder.Corrupt):
        range_coder.FrequencyTable.from_bytes(table.to_bytes()[:-5] + b"xxxxx")


LIBRARY = Tokenizer.from_file(FILE)
ENCODER = token_files.Encoder(FILE)
ODD = ["", " ", "  ", "a  b", "x\n y", "x\n \ny", "x \ny", " \t x", "x ", "x\n ", "a <|endoftext|> b", "x\n <|endoftext|>", "it's  'll", "  x", "a  b",
       "a\x1c b", "\x85 y", "1 2\r\n 3", "日本 語", "İ İ", "é ́", "word" * 50_000, "a b " * 20_000]


def test_encoder_equals_the_library_on_odd_texts():
    encoder = token_files.Encoder(FILE)
    for got, text in zip(encoder.encode(ODD, 2), ODD):
        assert np.frombuffer(got, encoder.width).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids + [2], text[:40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \t\n\r\x0b\x1c\x85\xa0\u3000aB1.'sé日", "<|endoftext|>", " \n ", "ab cd", "ö", "ǅx", "ĸ", "ab.", "x,", "ab.\nCd", "\nE", "ª", "ʼ", "don't"]), max_size=20).map("".join), max_size=4))
def test_encoder_equals_the_library(texts):
    encoder = ENCODER
    encoder.clear()
    assert [np.frombuffer(x, encoder.width).tolist() for x in encoder.encode(texts, 2)] == [
        LIBRARY.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_marks_behind_letters_do_not_go_through_all_steps(monkeypatch):
    encoder = token_files.Encoder(FILE)
    words = ["abc$$$", "Straße%%%,", "été\n\u00c9tait!?", "x|", "a-", "it_", "(", "don't", "ab<|endoftext|>", "9$"]
    texts = ["begin " + " ".join(words), "x " + " ".join(reversed(words))]
    want = [np.array(e.ids + [2], encoder.width).tobytes() for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts, 2) == want
    asked = []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text: asked.append(text) or ids(text))
    encoder._learn(["efg$$$", "Größe%%%,", "hij!?\nklm$$$", "opq()"])
    assert asked == ["()"]  # marks not seen before, once


def test_encoder_forgets_beyond_its_bound(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 3)
    monkeypatch.setattr(token_files, "SLICE_BYTES", 5)
    encoder = token_files.Encoder(FILE)
    texts = ["one two three", "four five six seven", "one nine", "two"]
    for _ in range(2):
        for got, text in zip(encoder.encode(texts, 2), texts):
            assert np.frombuffer(got, encoder.width).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids + [2]


def test_ids_are_counted_where_they_are_made(spark):
    texts = ["abc abc!", "Größe, Größe", None, "", "x\u0120 <|endoftext|> y  z"]
    df = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string").repartition(2)
    counts = token_files.tokenized(df, F.col("doc_id"), FILE).select("counts")  # without the ids
    got = {r["id"]: r["n"] for r in token_files._count_ids(counts).collect()}
    ids = np.concatenate([[*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2] for t in texts * 3])
    assert got == dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True))))


def dataset(spark, rows, schema, key="doc_id", **settings):
    df = spark.createDataFrame(rows, schema).repartition(3)
    folder = scratch_path(spark, "token-test")
    token_files.write(token_files.tokenized(df, F.col(f"`{key}`"), FILE), folder, **settings)
    return folder, df.schema[key].dataType


def expected(rows):
    """Brute force: rows (key, text) in ascending order of key, CRC and length."""
    coded = []
    for key, text in rows:
        ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        coded.append((key is not None, key or 0, zlib.crc32(ids.astype("<u2")), len(ids), ids))
    out, at = [], 0
    for *_, n, ids in sorted(coded, key=lambda x: x[:4]):
        out.append((at, n, zlib.crc32(ids)))
        at += n
    return out


def test_files_of_odd_rows_in_many_files_and_splits(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(60))), "x", "y") for i in range(300)]
    rows += [(None, "no key", "", ""), (None, None, "", ""), (5, None, "", ""), (5, "again", "", ""), (5, "again", "", ""), (900, "", "", ""),
             (901, "very long " * 30_000, "", "")] + [(7, "hot key", "", "")] * 200
    schema = "doc_id long, text string, `key` string, `a.b` string"
    folder, kind = dataset(spark, rows, schema, file_ids=4000, block=1000)
    got = token_files.read(spark, folder, kind, split_ids=700).collect()
    key = lambda r: (r.key is not None, r.key or 0)
    assert sorted((r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got) == expected([r[:2] for r in rows])
    ordered = sorted(got, key=lambda r: r.start)
    assert [key(r) for r in ordered] == sorted(key(r) for r in ordered)
    assert spark.read.parquet(f"{folder}/manifest").count() > 5


def test_text_keys_and_an_empty_table(spark):
    folder, kind = dataset(spark, [("b", "two"), ("a", "one")], "id string, text string", key="id")
    assert [r.key for r in token_files.read(spark, folder, kind).orderBy("start").collect()] == ["a", "b"]
    folder, kind = dataset(spark, [], "doc_id long, text string")
    assert token_files.read(spark, folder, kind).count() == 0


def test_a_lost_attempt_leaves_no_trace_and_damage_is_seen(spark):
    folder, kind = dataset(spark, [(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    base = folder.removeprefix("file:")
    files = glob.glob(f"{base}/files/*.ids")
    with open(f"{base}/files/part-000000-999-lost.ids", "wb") as f:
        f.write(b"half a file")
    assert token_files.read(spark, folder, kind).count() == 50
    data = bytearray(open(files[0], "rb").read())
    data[30] ^= 255
    with open(files[0], "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="Corrupt"):
        token_files.read(spark, folder, kind).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_against_the_library(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = queries.QUERIES["op11_token_files"](spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    got = sorted(out.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in rows)
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == expected([tuple(r) for r in rows])
