"""Queries of the training-data operators on sf0.001: SQL where there is some, else the contract's columns."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_check import _rows, duck
from wattframe.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
COLUMNS = {
    "op2_ngram_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
                     "base_score": "double", "score": "double"},
    "op4_topk_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
                    "sequence_id": "bigint", "offset": "bigint"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op11_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


def test_all_and_the_pipeline_are_registered():
    names = set(E.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(queries.ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_query(spark, key):
    sdf = queries.QUERIES[key](spark, SF)
    rows = [tuple(r) for r in sdf.collect()]
    assert len(rows) >= 50
    if key in COLUMNS:
        assert dict(sdf.dtypes) == COLUMNS[key]
    if key in queries.ORACLES:
        cur = duck(SF).execute(queries.ORACLES[key])
        names = [d[0] for d in cur.description]
        assert {n: TYPES[t] for n, t in sdf.dtypes} == {d[0]: str(d[1]) for d in cur.description}
        assert _rows(sdf.columns, rows) == _rows(names, cur.fetchall())


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    rows = queries.QUERIES["op2_ngram_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.n_known <= r.n_tokens for r in rows)
