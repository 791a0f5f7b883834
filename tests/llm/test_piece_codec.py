import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import piece_codec as C


def small(bpe, seed, byte_fallback=True):
    r = random.Random(seed)
    texts = sorted({"".join(r.choice("ab" + C.SPACE) for _ in range(r.randint(1, 3))) for _ in range(14)} | {"a", "b", C.SPACE, "ab", "bc"})
    texts = [t for t in texts if C.SPACE not in t.lstrip(C.SPACE)]
    scores = r.sample(range(-100, 0), len(texts))
    base = 256 if byte_fallback else 1
    output = ([bytes([i]) for i in range(256)] if byte_fallback else [b"?"]) + [t.replace(C.SPACE, " ").encode() for t in texts]
    return C.Pieces({base + i: t for i, t in enumerate(texts)}, dict(zip(texts, map(float, scores))),
                    list(range(256)) if byte_fallback else None, 0, output, bpe)


def viterbi(p, text):
    best = {0: (0.0, [])}
    for i in range(len(text)):
        if i in best:
            for t, s in p.score.items():
                if text.startswith(t, i) and (i + len(t) not in best or best[i][0] + s > best[i + len(t)][0]):
                    best[i + len(t)] = (best[i][0] + s, best[i][1] + [t])
    return best[len(text)]


@pytest.mark.parametrize("seed", range(6))
def test_bpe_equals_merging(seed):
    p, r = small(True, seed), random.Random(seed)
    for _ in range(60):
        t = "".join(r.choice("ab c\nd") for _ in range(r.randint(0, 14)))
        got = np.frombuffer(C.encode_texts(p, [t])[0], "<u4").tolist()
        want = []
        if t:
            for part in p.merge(C.SPACE + t.replace(" ", C.SPACE)):
                want += [p.id_of[part]] if part in p.id_of else p.fallback(part)
        assert got == want, t
        assert C.decode_ids(p, C.encode_texts(p, [t])[0]) == t


@pytest.mark.parametrize("seed", range(4))
def test_unigram_equals_brute_force(seed):
    p, r = small(False, seed), random.Random(seed)
    p.score.pop("bc")
    p = C.Pieces({i: t for i, t in p.text.items() if t != "bc"}, p.score, p.byte_ids, 0, p.output, False)
    for _ in range(60):
        t = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
        got = np.frombuffer(C.encode_texts(p, [t])[0], "<u4").tolist()
        assert sum(p.score[p.text[i]] for i in got) == viterbi(p, C.SPACE + t)[0]
        assert "".join(p.text[i] for i in got) == C.SPACE + t


def test_unknown_piece_without_byte_fallback():
    p = small(True, 1, byte_fallback=False)
    assert 0 in np.frombuffer(C.encode_texts(p, ["aZb"])[0], "<u4").tolist()


def test_suffix_array_ranges_are_the_occurrences():
    p, text = small(True, 3), "abbaabab" * 3
    points = np.array([ord(c) for c in text], np.uint32)
    codes = (np.searchsorted(p.alphabet, points) + 1).astype(np.uint64)
    order, first = C.suffix_array(codes, p.words)
    begin, end = C.ranges(order, first, p.low, p.high)
    for i, b, e in zip(p.ids, begin, end):
        t = p.text_of[int(i)]
        assert sorted(order[b:e]) == [k for k in range(len(text)) if text.startswith(t, k)]


def test_public_model_equals_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    r = random.Random(0)
    texts = ["", "a", " ", "   ", "Hello  world ", "\n a\tb", "é ﬁ ①　z", "日本語 тест", "x" * 3000, "a▁b", "\x00q", "🎉🎉 ok", None, "the the"]
    texts += ["".join(r.choice("abcdefghijklmno  \n.,éßñ日語▁ж0123") for _ in range(r.randint(0, 200))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "ids int, text string")
    coded = C.encode(df, [F.col("ids").alias("key")], model)
    assert {k: None if v is None else np.frombuffer(v, "<u4").tolist() for k, v in coded.collect()} == {
        i: None if t is None else sp.encode(t) for i, t in enumerate(texts)}
    back = C.decode(coded, [F.col("key")], model)
    assert dict(back.collect()) == {i: None if t is None else t.replace("▁", " ") for i, t in enumerate(texts)}
    assert C.encode(df.limit(0), [F.col("ids").alias("key")], model).count() == 0
