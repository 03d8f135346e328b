"""Shapes of physical plans, with broadcasts turned off as they would be for large dimensions."""

from __future__ import annotations

import re

import pytest

from plantpulse.registry import queries
from plantpulse.operators import trailing
from plantpulse.plans import gold, production
from plantpulse.streaming.sample import STREAMS

SF = "/root/testdata/sf0.001"
IN_PYTHON = {"oee_by_plant_python", "health_band_python", "repeated_positions"}
RUNS_JOBS = {"failure_scores", "failure_score_facts"}
BATCH = sorted(set(queries()) - set(STREAMS) - RUNS_JOBS)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", BATCH)
def test_no_pairs_and_no_python(no_broadcast, name):
    plan = physical(queries()[name](no_broadcast, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in IN_PYTHON:
        assert not re.search(r"EvalPython|InPandas|InArrow", plan)


def test_no_table_is_broadcast_by_hint(no_broadcast):
    """With the size-based choice off, no join is a broadcast."""
    hinted = {name for name in BATCH if "BroadcastHashJoin" in physical(queries()[name](no_broadcast, SF))}
    assert hinted == set()


def test_filters_and_columns_reach_the_scan(sample, capsys):
    production.oee_daily_enterprise(sample, "2001-08-01").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_shipdate,2001-07-02" in plan and "LessThan(l_shipdate,2001-08-02" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(c.split(":")[0] for c in schema.split(",")) == {
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"}


def test_facts_are_reduced_before_the_join(no_broadcast, sample):
    """The scan of the fact feeds a partial aggregate, and no join sits below the first exchange."""
    lines = physical(production.oee_by_plant(sample)).splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "l_suppkey" in line)
    above = [line for line in reversed(lines[:scan])]
    first_exchange = next(i for i, line in enumerate(above) if "Exchange" in line)
    assert any("HashAggregate" in line for line in above[:first_exchange])
    assert not any("Join" in line for line in above[:first_exchange])


def test_feature_windows_share_one_partitioning(sample):
    axis = trailing.observation_axis(sample["fct_asset_telemetry"], sample.service_log())
    plan = physical(gold.feature_rows(axis))
    assert len(re.findall(r"hashpartitioning\(asset_id#\d+L, \d+\)", plan)) == 1


def test_each_feature_window_is_computed_once(sample):
    def windows(df) -> int:
        return df._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition(")

    assert windows(gold.feature_rows(trailing.observation_axis(sample["fct_asset_telemetry"], sample.service_log()))) == 11
    assert windows(gold.feature_vibration_7d(sample["fct_asset_telemetry"])) == 3
