"""Plan checks: what is read, where rows meet, and what happens to hot keys."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from plan_text import executed
from regioflux.operators import ranks
from regioflux.workload import county_queries, flow_queries, map_queries, risk_queries  # noqa: F401
from regioflux.workload import fixtures as fx
from regioflux.workload.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
PYTHON_SCANS = {"cells_scan", "file_years", "layer_files"}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_shape_of_every_query(spark, name):
    plan = physical(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_SCANS:
        assert not re.search(r"Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["cvi_rating", "nri_state_risk", "indicator_ratings", "pct_rank_scale", "top_states", "top_focus_flows"])
def test_ranks_do_not_gather_rows_in_one_task(spark, name):
    plan = physical(QUERIES[name](spark, SMALL))
    for part in plan.split("SinglePartition")[1:]:
        # Only partial results of a global aggregate may meet: the next operator is that aggregate.
        assert re.match(r"[^\n]*\n[\s:|+-]*\*?(\(\d+\) )?\w*(Aggregate|Project)", part)


def test_columns_and_filters_reach_the_scan(spark):
    plan = physical(QUERIES["pct_rank_scale"](spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double>" in plan
    flows = physical(QUERIES["state_net"](spark, SMALL))
    assert "l_extendedprice" not in flows and "o_totalprice" not in flows


def test_threshold_is_pushed_to_a_table_of_incidents(spark, tmp_path):
    fx.disasters(spark, SMALL).write.parquet(str(tmp_path / "d"))
    incidents = spark.read.parquet(str(tmp_path / "d"))
    from regioflux.operators.groups import incident_totals, recent_incidents

    plan = physical(incident_totals(recent_incidents(incidents, 1998), ["NATION_0"]))
    assert "GreaterThanOrEqual(fyDeclared,1998)" in plan
    assert "ReadSchema: struct<STUSPS:string,fyDeclared:int>" in plan


def test_top_per_group_cuts_before_the_shuffle(spark):
    plan = physical(QUERIES["top_focus_flows"](spark, SMALL))
    assert plan.count("WindowGroupLimit") == 2


def test_first_rows_are_taken_without_a_full_sort(spark):
    plan = physical(QUERIES["county_top10"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan


def test_histogram_is_shuffled_once(spark):
    plan = executed(QUERIES["pct_rank_scale"](spark, SMALL))
    assert "ReusedExchange" in plan
    assert len(re.findall(r"FileScan", plan)) == 1 + 1  # the rows and their histogram


def test_incident_layer_reads_incidents_once(spark):
    plan = optimized(QUERIES["disaster_layer"](spark, SMALL))
    assert plan.count("o_orderpriority") and len(re.findall(r"Relation \[o_orderkey", plan)) == 1


def test_hot_value_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 120000, numPartitions=8)
        df = ids.select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"))
        ranked = ranks.add_percent_rank(df, "x", "p")
        plan = executed(ranked)
        assert "SortMergeJoin(skew=true)" in plan
        assert ranked.where("x = -1").agg(F.count("*"), F.max("p")).first()[:] == (40000, 0.0)
        assert ranked.agg(F.max("p")).first()[0] == 100.0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
