"""One account holds a third of all subscriptions and churn events: the
panel does not depend on how the sequencers split it."""
from pyspark.sql import functions as F

from churnlens.operators import facts
from churnlens.operators.panel import build_panel
from churnlens.sources.adapter import raw_tables
from tests.compare import _rows


def _hot(df, col="account_id"):
    return df.withColumn(col, F.when(F.abs(F.hash(*[c for c in df.columns if c.endswith("_id")])) % 3 == 0,
                                      F.lit("1")).otherwise(F.col(col)))


def test_hot_account_panel_does_not_depend_on_partitioning(spark):
    """The sequencers split the hot account differently under each setting."""
    r = raw_tables(spark, "/root/testdata/sf0.001")
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            sf = facts.subscription_fact(_hot(r.subscriptions))
            assert sf.where(F.col("account_id") == "1").count() > 100
            p = build_panel(r.accounts, sf, r.feature_usage, facts.tickets_fact(_hot(r.support_tickets)),
                            facts.churn_fact(_hot(r.churn_events)), "quarter")
            got.append(_rows(p.toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
