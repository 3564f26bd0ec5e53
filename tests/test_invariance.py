"""Same panel with 1 and 8 shuffle partitions, and with the range sequencer."""
from churnlens.plans.inputs import panel
from tests.compare import _rows


def test_partition_invariance(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        a = panel(spark, "/root/testdata/sf0.001", "quarter").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("churnlens.sequence.method", "range")
    try:
        b = panel(spark, "/root/testdata/sf0.001", "quarter").toPandas()
    finally:
        spark.conf.unset("churnlens.sequence.method")
    assert _rows(a) == _rows(b)
