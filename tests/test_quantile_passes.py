"""Passes over intervals that few values lie in unpivot those values only."""

import math

from pyspark.sql import functions as F

from churnlens.operators import stats

CUTS = [(("a",), 0, 10.0, 20.0, False), (("a",), 1, 300.0, 301.0, False), (("b",), 2, -1.0, 999.0, True)]


def test_counts_without_groups_join_nothing_and_equal_those_with(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("a"),
                                  F.when(F.col("id") % 3 == 0, F.sin("id") * 500).alias("b"))
    own = stats._counted(df, ["a", "b"], CUTS)
    assert "Join" not in own._jdf.queryExecution().executedPlan().toString()
    grouped = stats._counted_by(spark, df, ["a", "b"], ["g"], [((1, *key), *rest) for key, *rest in CUTS])
    rows = sorted(map(tuple, own.select("i", "b", "c", "lo", "hi").collect()))
    assert rows == sorted(map(tuple, grouped.select("i", "b", "c", "lo", "hi").collect()))
    assert [sum(r[2] for r in rows if r[0] == i) for i in (0, 1)] == [11, 2]


def test_missing_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, math.nan, None), (None, 2.0, None), (4.0, 8.0, None)], "x double, y double, z double")
    got = {r.feature: r.q0 for r in stats.exact_quantiles(df, ["x", "y", "z"], [0.5]).collect()}
    assert got == {"x": 2.5, "y": 5.0}
