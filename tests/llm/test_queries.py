"""Every query of this subpackage on the smallest tables: against SQL where there is some, and the shape of its plan."""

import pytest

import __spark_entry__ as contract
from refscope.llm.oracle import ORACLE
from refscope.llm.queries import QUERIES
from tests.compare import differences
from tests.conftest import nested_loops

NATIVE = ("op3_url_filter", "op5_line_dedup", "op9_license_scan", "op10_decontamination")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, plans, name):
    df = QUERIES[name](spark, SF)
    plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
    assert nested_loops(plans) == []
    if name in NATIVE:
        assert [label for label, plan in plans if "Python" in plan or "Pandas" in plan or "Arrow" in plan] == []
    assert contract.queries()[name] is QUERIES[name]
    if name in ORACLE:
        assert differences(df, SF, ORACLE[name]) == []
    else:
        assert df.count() > 0
