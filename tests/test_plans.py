"""Plan shape checks on the driver tables: pruning, pushdown, no Python outside the planner."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_state_plan_prunes_and_pre_aggregates(spark):
    p = plan(E.queries()["latest_status"](spark, SF))
    assert "PushedFilters: [IsNotNull(user_id)]" in p
    # the events scan reads only the columns the state needs
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in p
    assert "partial_max" in p  # map-side partial aggregation before the shuffle
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_no_python_outside_planner(spark):
    for key in ("broken_docks", "top_broken_docks", "station_pairs", "area_mean_ratio", "occupancy_color", "ratio_histogram"):
        p = plan(E.queries()[key](spark, SF))
        assert "Python" not in p, key
    assert "FlatMapGroupsInPandas" in plan(E.queries()["plan_routes"](spark, SF))


def test_no_cross_join_and_no_forced_broadcast(spark):
    for key in ("enrich_status", "latest_status", "station_pairs", "degree_pairs", "broken_docks"):
        p = plan(E.queries()[key](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key
        assert "strategy=broadcast" not in E.queries()[key](spark, SF)._jdf.queryExecution().analyzed().toString(), key


def test_docks_scan_prunes_supplier_columns(spark):
    p = plan(E.queries()["broken_docks"](spark, SF))
    assert "s_acctbal" not in p and "struct<s_suppkey:bigint,s_name:string>" in p


def test_batch_split_filter_reaches_the_scan(spark):
    from stationflow.plans import registry as R

    _, first, _ = R._two_batches(spark, SF)
    assert "PushedFilters: [In(event_type, [click,view])]" in plan(first)
