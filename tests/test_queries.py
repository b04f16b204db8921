"""Every registered query against its SQL, row by row, and the shape of its plan."""

import pytest
from oracle import check, connect

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name in ORACLES:
        assert check(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["qid", "n_ctx", "system", "user"]


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    assert "struct<user_id:bigint,event_type:string>" in plan_of(QUERIES["tool_used_flag"](spark, sf_dir))
    plan = plan_of(QUERIES["run_counts"](spark, sf_dir))
    assert "EqualTo(role,user)" in plan and "struct<conv_id:bigint,role:string>" in plan


@pytest.mark.parametrize("name", ["iteration_cap", "knn_topk", "dedupe_registry", "tool_loop"])
def test_groups_are_limited_before_the_shuffle(spark, sf_dir, name):
    from docweft.plans.composed import order_calls

    df = order_calls(spark, sf_dir) if name == "tool_loop" else QUERIES[name](spark, sf_dir)
    plan = plan_of(df)
    assert "WindowGroupLimit" in plan and "Partial" in plan
