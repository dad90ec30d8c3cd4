"""Every registered query against its SQL on the same tables."""

import pytest

from compare import assert_same
from panelweave.plans import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, duck, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    data = [tuple(r) for r in df.collect()]
    assert data
    if key in ORACLES:
        cur = duck.execute(ORACLES[key])
        assert_same(df.columns, data, [c[0] for c in cur.description], cur.fetchall())
