"""The panel's rows stay in the order of their account's period ends, up to the snapshot."""

import datetime as dt

from pyspark.sql import functions as F

from churnlens.operators import panel as pn
from churnlens.operators.calendar import account_spine
from churnlens.plans import jobs
from churnlens.plans.inputs import load_facts
from churnlens.session import compile_projections
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_snapshot_sorts_no_panel_row_again(spark):
    compile_projections(spark)
    plan = _plan(pn.latest_snapshot(load_facts(spark, SF_SMALL).panel("month"), "period_end"))
    windows = [i for i, line in enumerate(plan) if "Window [" in line and "period_end" in line]
    assert windows and not [line for line in plan[:windows[-1]] if " Sort [" in line]


def test_spine_rows_are_not_shuffled(spark):
    plan = _plan(load_facts(spark, SF_SMALL).panel("quarter"))
    explode = next(i for i, line in enumerate(plan) if "Generate explode" in line and "signup_date" in line)
    assert [line for line in plan[explode:] if "hashpartitioning(account_id" in line and "ENSURE_REQUIREMENTS" in line]
    assert not [line for line in plan if "Window [avg(" in line or "Window [" in line and " avg(" in line]


def test_stage_is_read_as_sorted(spark, tmp_dir):
    stage = jobs.Stage("stage_in_order", f"{tmp_dir}/stage", 3)
    p = load_facts(spark, SF_SMALL).panel("quarter").select("account_id", "quarter_end", "usage_count")
    stage.write(p)
    snap = pn.latest_snapshot(stage.open(spark), "quarter_end")
    assert not [line for line in _plan(snap) if " Sort [" in line or "Exchange" in line]
    want = p.groupBy("account_id").agg(F.max("quarter_end").alias("quarter_end"))
    assert sorted(map(tuple, snap.select("account_id", "quarter_end").collect())) == sorted(map(tuple, want.collect()))


def test_an_account_with_two_signups_is_one_row_a_period(spark):
    rows = [("a", dt.date(2020, 2, 1)), ("a", dt.date(2020, 8, 1)), ("a", dt.date(2020, 9, 1)), ("b", dt.date(2020, 5, 1)), ("c", None)]
    accounts = spark.createDataFrame(rows, "account_id string, signup_date date")
    bounds = spark.createDataFrame([(2020 * 4, 2020 * 4 + 3)], "min_idx int, max_idx int")
    every = account_spine(accounts, bounds).groupBy("account_id", "p_idx").agg(F.max("signup_date").alias("signup_date"))
    one = account_spine(accounts, bounds, single=True).select("account_id", "p_idx", "signup_date")
    assert one.count() == 7 and sorted(map(tuple, one.collect())) == sorted(map(tuple, every.collect()))


def test_latest_row_without_an_end_and_with_one(spark):
    rows = [("a", None, 1), ("a", dt.date(2020, 3, 31), 2), ("a", dt.date(2020, 6, 30), 3), ("b", None, 4)]
    p = spark.createDataFrame(rows, "account_id string, e date, v int")
    assert sorted(r["v"] for r in pn.latest_snapshot(p, "e").collect()) == [3, 4]
