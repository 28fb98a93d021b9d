import os

import pytest

from support import DATA, compare
from veriframe.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    compare(spark, registry.queries(), registry.oracle_sql(), name)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0


@pytest.mark.parametrize("name", ["q143_rule_cascade", "q144_three_pass_final"])
def test_passes_are_sorted_once(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == plan.count("Exchange ") == 1 and "Aggregate" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_staged_match_of_codes_alike(spark, tmp_path):
    """Customers whose digests begin with the same ten characters, or differ in the eighth alone, each get their own code."""
    import duckdb

    keys = "(805733, 10), (1090164, 10), (999594, 20), (9209485, 20), (363976, 3), (441591, 9), (0, 2), (9223372036854775807, 8), (-7, 24)"
    copy = f"copy (select c_custkey::bigint as c_custkey, c_nationkey::int as c_nationkey from (values {keys}) t(c_custkey, c_nationkey)) to '{tmp_path}/customer.parquet' (format parquet)"
    duckdb.connect().execute(copy)
    assert compare(spark, registry.queries(), registry.oracle_sql(), "q124_staged_match", str(tmp_path)) == 9
