"""What the plans of the queries look like."""

import importlib

import pytest

from test_oracles import MODULES, plans


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,mod", [pytest.param(n, m, id=n) for n, m in plans()])
def test_no_nested_loops(spark, data, name, mod):
    plan = text(mod.queries()[name](spark, data))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_and_filters_reach_the_scan(spark, data):
    scans = importlib.import_module("peakloom.plans.scans").queries()
    plan = text(scans["s3_projected_scan"](spark, data))
    assert "ms2_mzs" not in plan and "PushedFilters: [IsNotNull(adduct), IsNotNull(precursor_mz), EqualTo(adduct" in plan
    plan = text(importlib.import_module("peakloom.plans.training").queries()["p5_found"](spark, data))
    assert "ReadSchema: struct<inchikey14:string,instrument_type:string>" in plan


def test_rank_limits_come_before_the_exchange(spark, data):
    plan = text(importlib.import_module("peakloom.plans.relational").queries()["n2_capped_sample"](spark, data))
    assert plan.count("WindowGroupLimit") == 2


def test_names_are_unique():
    names = [n for m in MODULES for n in importlib.import_module(f"peakloom.plans.{m}").queries()]
    assert len(names) == len(set(names))
