"""Rounding without decimals is Spark's rounding, and registered queries have their wide projections compiled."""

from pyspark.sql import functions as F

from churnlens.functions.columns import round_half_up
from churnlens.plans.catalog import QUERIES
from churnlens.session import COMPILED_METHODS
from tests.conftest import SF_SMALL


def test_round_half_up_is_round(spark):
    odd = [0.0, -0.0, -1e-9, 0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, 0.1234565, 0.1234575, 1.0000005, -2.0000015, 1 / 3, -2 / 3, 1 / 64, 1 / 128,
           9999999.9999995, 1e7, -1e7, 12345678.1234565, 1e15, 1e300, 5e-324, float("nan"), float("inf"), float("-inf"), None]
    rows = [(v,) for v in odd] + [(k * 0.5e-6,) for k in range(-2000, 2000)] + [(k / 3600,) for k in range(5000)]
    d = spark.createDataFrame(rows, "v double").select("v", round_half_up(F.col("v")).alias("a"), F.round("v", 6).alias("b"))
    # as text, so that signed zeros and NaN count too
    assert d.where(~F.col("a").cast("string").eqNullSafe(F.col("b").cast("string"))).collect() == []


def test_queries_compile_wide_projections(spark):
    key, limit = next(iter(COMPILED_METHODS.items()))
    spark.conf.unset(key)
    QUERIES["month_panel"](spark, SF_SMALL)
    assert spark.conf.get(key) == limit
    spark.conf.set(key, "9000")
    QUERIES["date_range"](spark, SF_SMALL)
    assert spark.conf.get(key) == "9000"
    spark.conf.set(key, limit)
