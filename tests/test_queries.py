import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
from oracle_queries import ORACLES as study_oracles
from troughline.plans.study_queries import QUERIES as study_queries
from conftest import SMALL

TABLES = ("customer", "orders", "events")
# the text operators have tests of their own
ORACLES, QUERIES = study_oracles, study_queries


def truth_of(sql):
    """The oracle's rows; an internal error of its engine (not a wrong answer) is tried once more."""
    for last in (False, True):
        con = duckdb.connect()
        for table in TABLES:
            con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
        try:
            return con.execute(sql).df()
        except duckdb.InternalException:
            if last:
                raise


def test_entry(spark):
    rows = {(r.day, r.CRCL): r for r in contract.entry(spark).collect()}
    assert len(rows) == 28


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(ORACLES) <= set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    mine = QUERIES[name](spark, SMALL).toPandas()
    truth = truth_of(ORACLES[name])
    columns = sorted(mine.columns)
    assert columns == sorted(truth.columns)
    assert len(mine) == len(truth)
    a = mine[columns].sort_values(columns, ignore_index=True)
    b = truth[columns].sort_values(columns, ignore_index=True)
    for column in columns:
        if a[column].dtype.kind in "fiu":
            np.testing.assert_allclose(a[column].astype(float), b[column].astype(float), rtol=0, atol=1e-9)
        else:
            assert list(a[column]) == list(b[column])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
