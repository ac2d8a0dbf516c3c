import os

import pytest

from tessera.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: Queries that have no row on the smallest tables.
EMPTY_HERE = {"click_q19", "click_q37", "click_q38", "click_q41", "click_q42", "join_residual", "tpch_q7"} if SF.endswith("sf0.001") else set()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_as_sql(name, same):
    rows = same(registry.queries()[name], registry.oracle_sql()[name])
    assert rows or name in EMPTY_HERE


def test_pushed_filter_and_pruned_columns(spark, sf):
    plan = registry.queries()["scan_pushed_filter"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(o_totalprice,200000.0)" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema: ")[-1]


def test_top_k_plan(spark, sf):
    assert "TakeOrderedAndProject" in registry.queries()["top_k"](spark, sf)._jdf.queryExecution().toString()
