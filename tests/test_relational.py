from __future__ import annotations

import pytest
from conftest import SF

from quarrystone.plans import ORACLE_SQL, QUERIES


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    names, data, columns = oracle(ORACLE_SQL[name])
    assert sorted(df.columns) == names
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, data)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filter_project"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_unknown_table(spark):
    from quarrystone.sources import table

    with pytest.raises(ValueError):
        table(spark, SF, "nowhere")
