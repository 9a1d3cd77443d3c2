"""Every query against its SQL on the smallest tables, and the shape of its plan."""

import pytest

import __spark_entry__ as contract
from contract.queries import QUERIES
from tests.compare import differences
from tests.conftest import nested_loops

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, plans, name):
    df = QUERIES[name](spark, SF)
    # No plan, nor any behind a cut, may fall back to comparing every row with every row.
    assert nested_loops([*plans, (name, df._jdf.queryExecution().executedPlan().toString())]) == []
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, SF, sql) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["job_id", "project_name", "usage_type", "usages"]
    assert df.count() > 0
