"""Every registered query equals its SQL, and its plan holds no pairing of whole tables."""

import pytest

import __spark_entry__ as entry
import check
from cantera.plans.registry import QUERIES, SQL
from conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, duck, name):
    good, message = check.compare(spark, duck, SMALL, name)
    assert good, message


def test_only_the_iterative_query_lacks_sql():
    assert set(QUERIES) - set(SQL) == {"learned_embedding"}


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[:3] == ["qid", "id", "lists"] and result.count() > 0


PLANNED = [name for name in QUERIES if "stream" not in name]


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join_and_no_row_at_a_time_python(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in plan


def plan_of(spark, name):
    return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_their_columns(spark):
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan_of(spark, "duplicate_keys")
    assert "PushedFilters: [IsNotNull(o_custkey), GreaterThanOrEqual(o_custkey,100)]" in plan_of(spark, "resume_key")


def test_position_becomes_a_pushed_filter(spark):
    assert "GreaterThan(o_orderkey" in plan_of(spark, "resume_offset")


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = plan_of(spark, "track_knn")
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
