"""What the panel and its consumers write: each input is dealt by account once, stored rows are packed columns."""

import re

from pyspark.sql import functions as F

from churnlens.operators import panel as pn
from churnlens.operators import upload
from churnlens.operators.ordered import sequence_within
from churnlens.plans import catalog, jobs
from churnlens.plans.inputs import load_facts
from churnlens.session import compile_projections, stored
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pre_aggregate_is_shuffled_for_the_collapse(spark):
    """A union lost how its parts were dealt, so that all of their rows were shuffled again."""
    compile_projections(spark)
    for grain in ("quarter", "month"):
        plan = _plan(load_facts(spark, SF_SMALL).panel(grain))
        assert "Union" not in plan
        exploded = plan.index("Generate explode(sequence(lo")
        above = [line for line in plan[:exploded].splitlines()[-4:] if "Exchange" in line]
        assert not above  # keys exploded over periods stay where their account is


def test_raw_usage_is_shuffled_once_before_it_meets_its_account(spark):
    compile_projections(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = load_facts(spark, SF_SMALL)
        plan = _plan(pn.usage_rows(f.usage, f.subscriptions))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"Exchange hashpartitioning\((subscription_id[^)]*)\)", plan)
    assert len(dealt) == 2 and all(d.count("#") == 1 for d in dealt)  # usage and its map, each by subscription alone


def test_stored_rows_are_read_as_they_were(spark):
    df = spark.range(10).select(F.col("id"), F.when(F.col("id") > 3, F.lit("x")).alias("t"), (F.col("id") / 3).alias("d"))
    back = stored(df)
    assert "parquet" in _plan(back).lower() and back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert stored(df.withColumn("nothing", F.lit(None))).count() == 10


def test_sequence_and_panel_are_stored_as_columns(spark):
    f = load_facts(spark, SF_SMALL)
    assert "ExistingRDD" not in _plan(f.sub_fact)
    p = jobs.processed_quarter_panel(f, columns=["account_id", "quarter"])
    assert "ExistingRDD" not in _plan(p) and "usage_count_roll4_mean" not in p.columns
    assert "usage_count_roll4_mean" in jobs.processed_quarter_panel(f, materialise=False).columns


def test_fixtures_store_the_columns_they_have(spark):
    for df in (catalog.single_fixture(spark, SF_SMALL), *catalog.quarterly_fixture(spark, SF_SMALL)):
        plan = _plan(df)
        assert "ExistingRDD" not in plan and "roll4" not in plan and "Window" not in plan


def test_counted_events_add_up(spark):
    rows = spark.sql("select * from values ('a', date'2020-02-01'), ('a', date'2020-03-01'), ('a', date'2020-05-01'), ('b', null) as t(account_id, churn_date)")
    got = {(r.account_id, r.p_idx): (r.churn_in, r.churn_next, r.churn_next2) for r in pn.churn_by_period(rows).collect()}
    q = 2020 * 4
    assert got == {("a", q): (2, 1, 0), ("a", q + 1): (1, 0, 0), ("a", q - 1): (0, 2, 1), ("a", q - 2): (0, 0, 2)}


def test_sequence_of_rows_with_an_empty_type(spark):
    df = spark.range(5).withColumn("nothing", F.lit(None))
    assert sorted(r.k for r in sequence_within(df, [], ["id"], seq_col="k").collect()) == [1, 2, 3, 4, 5]


def test_history_without_an_order_keeps_its_last_row(spark, tmp_path):
    """Rows are numbered as they are read, before they are dealt by account."""
    rows = [(f"a{i % 7}", "2020-01-01", float(i)) for i in range(700)]
    spark.createDataFrame(rows, "account_id string, as_of_quarter string, usage_count_total double").coalesce(1).write.parquet(f"{tmp_path}/h")
    h = upload.dedup_history(upload.dealt_history(spark.read.parquet(f"{tmp_path}/h").withColumn("unused", F.lit(1))))
    assert "unused" not in h.columns
    assert {r.account_id: r.usage_count_total for r in h.collect()} == {f"a{i}": 693.0 + i for i in range(7)}
    plan = _plan(upload.history_medians(h))
    assert plan.count("Exchange hashpartitioning") == 1
