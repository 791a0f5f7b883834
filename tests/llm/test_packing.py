import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import packing

P = pytest.importorskip("public_tokenizers")
FILES = {"rank_file": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def squares(counts):
    return sum(int(c) ** 2 for c in counts)


def test_level_choice_minimises_the_sum_of_squares():
    r = random.Random(0)
    p = packing.Packer(window=16, max_open=10_000)
    for i in range(2000):
        size = r.randint(1, 15)
        before = p.counts[:16].copy()
        options = []
        for level in range(0, 17 - size):
            if level == 0 or before[level]:
                after = before.copy()
                if level:
                    after[level] -= 1
                if level + size < 16:
                    after[level + size] += 1
                options.append(squares(after))
        list(p.add(i, np.zeros(size, "<u4")))
        assert squares(p.counts[:16]) == min(options)
        assert [len(x) for x in p.levels] == p.counts[:16].tolist()


@pytest.mark.parametrize("max_open", [4, 10_000])
def test_every_id_is_in_one_piece_and_one_window_is_left(max_open):
    r = random.Random(1)
    docs = {i: np.arange(i * 1000, i * 1000 + r.choice([1, 9, 10, 20, 37]), dtype="<u4") for i in range(500)}
    p = packing.Packer(window=16, max_open=max_open)
    windows = [w for i, ids in docs.items() for w in p.add(i, ids)] + list(p.close())
    fills = [sum(len(ids) for *_, ids in w) for w in windows]
    assert all(f == 16 for f in sorted(fills)[1:]) and max(fills) == 16
    got = {i: {} for i in docs}
    for w in windows:
        for i, start, ids in w:
            got[i].update(zip(range(start, start + len(ids)), ids.tolist()))
    assert {i: [x for _, x in sorted(g.items())] for i, g in got.items()} == {i: d.tolist() for i, d in docs.items()}


def test_pieces_of_texts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(2)
    texts = [" ".join(r.choice(["The", "çé", "x1", "\n", "words'll", "日本", "<|endoftext|>", "  "]) for _ in range(r.choice([0, 3, 50, 700, 3000]))) for _ in range(60)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(100, None, "x"), (101, "", "x"), (None, "null key", "x"), (0, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    out = packing.pack(df, F.col("doc_id"), **FILES, with_ids=True).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in rows}
    seen, sequences = {}, {}
    for x in out:
        assert x.ids == ids[x.kept][x.start:x.start + x.length] and x.doc_tokens == len(ids[x.kept])
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        seen[x.kept] = seen.get(x.kept, 0) + x.length
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert seen == {i: len(v) * (2 if i == 0 else 1) for i, v in ids.items()}
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        short += at < 1024
    assert short <= 3
    assert packing.pack(df.limit(0), F.col("doc_id"), **FILES).count() == 0
