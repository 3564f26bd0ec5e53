import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators.ordered import sequence_within


def _rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def _window(df, keys, order, seq, lead, sums):
    w = Window.partitionBy(*keys).orderBy(*order)
    cum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", F.row_number().over(w).cast("long").alias(seq), *[F.lead(s).over(w).alias(d) for s, d in lead.items()],
                     *[F.sum(F.col(s).cast("double")).over(cum).alias(d) for s, d in sums.items()])


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows have one key; a nullable integer key; ties; leading nulls in the summed column."""
    rnd = random.Random(7)
    rows = [(9 if i % 2 == 0 else (None if i % 17 == 0 else i % 17), rnd.randint(0, 50), i,
             None if rnd.random() < .5 else float(rnd.randint(0, 3))) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, t int, id int, v double").repartition(7)


ARGS = dict(key_cols=["k"], order_cols=["t", "id"], seq_col="seq",
            lead_cols={"t": "next_t"}, running_sums={"v": "cum_v"})
COLS = ["k", "id", "seq", "next_t", "cum_v"]


def test_equals_window_with_hot_and_null_keys(hot):
    want = _rows(_window(hot, ["k"], ["t", "id"], "seq", {"t": "next_t"}, {"v": "cum_v"}), COLS)
    got = sequence_within(hot, num_partitions=13, **ARGS)
    assert _rows(got, COLS) == want
    assert _rows(got.coalesce(1), COLS) == want
    assert _rows(got.coalesce(2).unionByName(got.limit(0)), COLS) == want
    assert "mapInArrow" not in got._jdf.queryExecution().toString()


def test_keyless_sequence(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit(1.0).alias("one"))
    b = sequence_within(df, key_cols=[], order_cols=[F.col("x").desc()], seq_col="k",
                        running_sums={"one": "c"}, num_partitions=9)
    got = {r.x: (r.k, r.c) for r in b.coalesce(3).collect()}
    assert all(got[x] == (5000 - x, float(5000 - x)) for x in range(5000))


def test_empty(spark):
    df = spark.createDataFrame([], "k int, t int, id int, v double")
    assert sequence_within(df, **ARGS).count() == 0
