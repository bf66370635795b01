"""Every registered query against its SQL on the small tables (set SLINK_SF_DIR for larger ones)."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF_DIR = os.environ.get("SLINK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    problem, rows = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert not problem
    # The smallest tables hold no open group with questions.
    assert rows > 0 or name == "o5_next_open_group"


def test_every_check_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_no_cross_joins(spark):
    for name in ("m15_link_schema", "q4_comma_join", "q7_repeat_same_brand", "q11_ratio_to_total", "v4_evaluation_report"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["q8_semi_join_having"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["question_id", "tokens", "schema_ddl"]
