"""Every registered query of the engine against its DuckDB counterpart."""

import pytest

from graphloom.plans.catalogue import ORACLE_SQL, QUERIES

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE_SQL:
        oracle.compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF)
    else:
        assert QUERIES[name](spark, SF).count() > 0
