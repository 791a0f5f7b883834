"""Every key of the base library against its DuckDB oracle (or a row check) on sf0.001."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_check import _rows, duck
from wattframe.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load_all()
KEYS = sorted(catalog.QUERIES)
ORACLES = catalog.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns == ["Library_Name", "N", "Mean_M1", "Mean_M2", "Mean_M3"]


def test_every_key_has_oracle_or_is_known_rows_only():
    rows_only = set(KEYS) - set(ORACLES)
    assert rows_only <= {"linreg_ols_fit", "linreg_gd", "logreg_l2", "logreg_plain", "mlp_classify",
                         "fit_time", "stamp_run", "stat_tests_pvalues", "anova_two_way_pvalues"}
    assert set(ORACLES) <= set(KEYS)
    assert set(KEYS) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


# Spark type name -> DuckDB type name
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE"}


@pytest.mark.parametrize("key", KEYS)
def test_key(spark, con, key):
    sdf = catalog.QUERIES[key](spark, SF)
    cols = sdf.columns
    recs = [tuple(r) for r in sdf.collect()]
    if key not in ORACLES:
        assert len(cols) == len(set(cols))
        return
    cur = con.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    assert {n: TYPES.get(t, t) for n, t in sdf.dtypes} == dtypes
    sc, sr = _rows(cols, recs)
    dc, dr = _rows(dcols, cur.fetchall())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
