import datetime as dt

from pyspark.sql import functions as F

from churnlens.functions.periods import (label_to_index, period_end, period_index, period_label, period_start,
                                         within_period_cut)


def test_quarter_roundtrip(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 31),), (dt.date(2024, 4, 1),), (dt.date(1999, 12, 31),)], "d date")
    r = df.select(period_label(period_index("d")).alias("q"), period_start(period_index("d")).alias("s"),
                  period_end(period_index("d")).alias("e"),
                  label_to_index(period_label(period_index("d"))).alias("i2"), period_index("d").alias("i")).collect()
    assert [x.q for x in r] == ["2024Q1", "2024Q2", "1999Q4"]
    assert [x.s for x in r] == [dt.date(2024, 1, 1), dt.date(2024, 4, 1), dt.date(1999, 10, 1)]
    assert [x.e for x in r] == [dt.date(2024, 3, 31), dt.date(2024, 6, 30), dt.date(1999, 12, 31)]
    assert all(x.i == x.i2 for x in r)


def test_month_labels(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 10),)], "d date")
    r = df.select(period_label(period_index("d", "month"), "month").alias("m"),
                  period_end(period_index("d", "month"), "month").alias("e")).first()
    assert r.m == "2024-02" and r.e == dt.date(2024, 2, 29)


def test_midnight_cut_on_last_day(spark):
    # a ticket after midnight on the quarter's last day is in no quarter (parity)
    rows = [(dt.datetime(2024, 3, 31, 0, 0),), (dt.datetime(2024, 3, 31, 9, 0),), (dt.datetime(2024, 3, 30, 9, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    kept = [r.k for r in df.select(within_period_cut("ts").alias("k")).collect()]
    assert kept == [True, False, True]
    full = [r.k for r in df.select(within_period_cut("ts", last_day_full=True).alias("k")).collect()]
    assert full == [True, True, True]
