"""What must and must not appear in physical plans."""

import pytest

from tidemark.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_and_no_row_wise_python(spark):
    bad = {}
    for name in QUERIES:
        text = plan(spark, name)
        found = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if w in text]
        if found:
            bad[name] = found
    assert bad == {}


@pytest.mark.parametrize("name", ["map_share", "daily_totals", "server_ranking", "request_totals"])
def test_window_reaches_the_scan(spark, name):
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan(spark, name)


@pytest.mark.parametrize("name", ["request_recent20", "upsert_latest", "dedupe_skip", "dedupe_stop", "auto_block"])
def test_limits_per_key_apply_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan(spark, "snapshot_ids")
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double,props:string>" in plan(spark, "map_share")


def test_top_lists_keep_n_rows_per_task(spark):
    assert "TakeOrderedAndProject(limit=10" in plan(spark, "map_share_top_other")


@pytest.mark.parametrize("name", ["rate_limit_exact", "request_admission", "cooldown_steps", "cooldown_state", "cycle_metrics"])
def test_state_machines_run_no_job_while_they_are_built(spark, name):
    tracker, group = spark.sparkContext.statusTracker(), f"built-{name}"
    spark.sparkContext.setJobGroup(group, "")
    QUERIES[name](spark, SF)
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup(group)) == 0


@pytest.mark.parametrize("name", ["rate_limit_exact", "cooldown_steps"])
def test_calm_rows_pass_no_python(spark, name):
    """Half of the union folds episodes; the other half is windows over cells."""
    quiet, folded = plan(spark, name).split("Union", 1)[1].split("MapInPandas", 1)
    assert "Window [" in quiet and "Python" not in quiet and "hashpartitioning(ip" in folded
