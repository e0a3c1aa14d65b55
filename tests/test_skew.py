"""One key holds a third of all rows: results stay exact, and plans keep their keys."""

from pathlib import Path

import pytest
from compare import TABLES, compare, duck

from tidepanel.plans import ALL_QUERIES, ALL_SQL

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")

HOT = {
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey) FROM orders",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey) FROM lineitem",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS event_type) FROM events",
}
QUERIES = [
    "month_calendar", "tcode_transform_fleet", "model_ready", "interp_first3", "inverse_one_step", "acf12", "predictive_percentiles",
    "predictive_prctile", "accuracy", "rolling_persistence",
]


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("hot")
    con = duck(SF)
    for name in TABLES:
        if name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            continue
        con.execute(f"COPY ({HOT.get(name, f'SELECT * FROM {name}')}) TO '{root}/{name}.parquet' (FORMAT parquet)")
    return str(root)


@pytest.mark.parametrize("name", QUERIES)
def test_hot_keys(spark, hot_dir, name):
    assert compare(spark, duck(hot_dir), hot_dir, ALL_QUERIES[name], ALL_SQL[name]).startswith("ok")


def test_joins_without_broadcast(spark):
    """With Spark's own broadcasting off, results are the same and no join loses its key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        con = duck(SF)
        for name in ["month_calendar", "accuracy", "inverse_blend_clip", "rolling_persistence", "chart_axis"]:
            assert compare(spark, con, SF, ALL_QUERIES[name], ALL_SQL[name]).startswith("ok"), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [n for n in sorted(ALL_SQL) if not n.startswith("fill")])
def test_no_cross_join(spark, name):
    plan = ALL_QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
