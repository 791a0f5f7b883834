import random
import zlib

import numpy as np
import pytest

from tests.llm.test_quality_rules import brute as brute_stats
from tests.llm.test_secret_scan import brute as brute_secrets
from tests.llm.test_simhash import slow_components, slow_fingerprint

import corpus_pipeline
from wattframe.llm import secret_scan


def fixture(n=60, seed=0):
    r = random.Random(seed)
    words = ["word%d" % i for i in range(400)]
    rows, i = [], 0
    while len(rows) < n:
        base = [r.choice(words) for _ in range(r.choice([10, 60, 150, 1500]))]
        for _ in range(r.choice([1, 1, 2, 4])):
            t = list(base)
            if r.random() < 0.5:
                t[r.randrange(len(t))] = "changed"
            if r.random() < 0.3:
                t.insert(5, 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"')
            rows.append((i, " ".join(t), r.choice(["en", None]), "src0", 0))
            i += 1
    rows += [(i, None, "en", None, None), (i + 1, "", "en", "s", 0), (i + 2, "a b c " * 60, "en", "s", 360), rows[0]]
    return rows


def expected(rows):
    """(document, text) of what reaches the packing, by the plain definitions."""
    kept = []
    for row in rows:
        n, *_, repeated = brute_stats(row[1])
        if not (n < 50 or 100 * repeated > 50 * n):
            kept.append(row)
    fps = {k: slow_fingerprint(t) for k, t, *_ in kept}
    group = slow_components(fps)
    first = {}
    for k, t, *_ in kept:
        if group[k] == k:
            first[k] = t
    out = {}
    for k, t in first.items():
        spans = brute_secrets(t)
        out[k] = secret_scan.redact(t, spans) if spans else t
    return out


def test_run_equals_brute_force(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {k: tok.encode(t, add_special_tokens=False).ids + [0] for k, t in expected(rows).items()}
    pieces, fill = {}, {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = want[p.doc_id][p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and p.doc_tokens == len(want[p.doc_id])
        pieces.setdefault(p.doc_id, []).append((p.start, p.length))
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert set(pieces) == set(want)
    for k, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(want[k])
    assert max(fill.values()) <= 1024


def test_stages_keep_the_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
