"""The panel explodes and shuffles keys of picked subscriptions, not the subscriptions."""

from pyspark.sql import functions as F

from churnlens.operators import panel as pn
from churnlens.plans.inputs import load_facts
from churnlens.session import compile_projections
from tests.conftest import SF_SMALL


def test_collapse_is_hashed(spark):
    plan = load_facts(spark, SF_SMALL).panel("quarter")._jdf.queryExecution().executedPlan().toString()
    lines = [line.split("functions=")[0] for line in plan.splitlines() if "Aggregate(key" in line and "p_idx" in line]
    assert lines and not [line for line in lines if "SortAggregate" in line]


def test_payload_meets_the_panel_without_a_second_shuffle(spark):
    compile_projections(spark)
    plan = load_facts(spark, SF_SMALL).panel("quarter")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(account_id" in line and "asof_key" in line]
    assert len(dealt) == 1  # the payload's own grouping


def test_a_repeated_key_doubles_no_period(spark):
    f = load_facts(spark, SF_SMALL)
    bounds = spark.createDataFrame([(1992 * 4, 1998 * 4 + 3)], "min_idx int, max_idx int")
    one = pn.asof_subscription(f.sub_fact, bounds).select("account_id", "p_idx", "asof.subscription_id")
    again = f.sub_fact.unionByName(f.sub_fact.withColumn("subscription_id", F.lit("")))
    two = pn.asof_subscription(again, bounds).select("account_id", "p_idx", "asof.subscription_id")
    assert one.count() > 1000 and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
