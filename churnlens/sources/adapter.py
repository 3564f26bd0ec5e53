"""Test-table adapter: derive the five raw customer-health tables from the
driver's TPC-H-style parquet tables with deterministic arithmetic only.

accounts        <- customer x nation
subscriptions   <- orders
support_tickets <- lineitem (returned lines) x orders
churn_events    <- orders (finished, low priority)
feature_usage   <- lineitem x part

Every table grows with the input, so all downstream work scales with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _day(c: str):
    return F.to_date(F.col(c))


def _usage_like_id():
    return F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.date_format(_day("l_shipdate"), "yyyy-MM-dd"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    tier = (F.when(F.col("c_custkey") % 3 == 0, "Basic")
            .when(F.col("c_custkey") % 3 == 1, "Pro").otherwise("Enterprise"))
    return (c.join(n, c.c_nationkey == n.n_nationkey, "inner")
            .select(F.col("c_custkey").cast("string").alias("account_id"),
                    F.col("c_name").alias("account_name"),
                    F.lower("c_mktsegment").alias("industry"),
                    F.col("n_name").alias("country"),
                    F.date_add(F.lit("1995-01-01").cast("date"),
                               (F.col("c_custkey") % 1400).cast("int")).alias("signup_date"),
                    tier.alias("plan_tier")))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    start = _day("o_orderdate")
    closed = F.col("o_orderstatus") != "O"
    plan = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Enterprise")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Pro").otherwise("Basic"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("subscription_id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        start.alias("start_date"),
        F.when(closed, F.date_add(start, (90 + F.col("o_orderkey") % 400).cast("int"))).alias("end_date"),
        plan.alias("plan_tier"),
        (1 + F.col("o_orderkey") % 97).cast("int").alias("seats"),
        (F.col("o_totalprice") / 12).alias("mrr_amount"),
        F.col("o_totalprice").alias("arr_amount"),
        F.when(F.col("o_orderkey") % 2 == 0, "annual").otherwise("monthly").alias("billing_frequency"),
        (F.col("o_orderkey") % 5 != 0).alias("auto_renew_flag"),
        closed.alias("churn_flag"),
    )


def support_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = (_read(spark, sf_dir, "lineitem")
          .where(F.col("l_returnflag") == "R")
          .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_tax"))
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        _usage_like_id().alias("ticket_id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        (F.col("l_shipdate").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), (F.col("l_linenumber") * 3).cast("int"))).alias("submitted_at"),
        F.when(F.col("l_linenumber") % 3 != 0, (1 + F.col("l_partkey") % 5).cast("int")).alias("satisfaction_score"),
        (F.col("l_tax") >= 0.06).alias("escalation_flag"),
    )


def churn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return (o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"))
            .select(F.col("o_orderkey").cast("string").alias("churn_event_id"),
                    F.col("o_custkey").cast("string").alias("account_id"),
                    F.date_add(_day("o_orderdate"), 60).alias("churn_date")))


def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return j.select(
        _usage_like_id().alias("usage_id"),
        F.col("l_orderkey").cast("string").alias("subscription_id"),
        _day("l_shipdate").alias("usage_date"),
        F.col("p_brand").alias("feature_name"),
        F.col("l_quantity").cast("int").alias("usage_count"),
        (F.col("l_quantity") * 90).cast("int").alias("usage_duration_secs"),
        F.when(F.col("l_returnflag") == "A", F.col("l_linenumber") % 3).otherwise(0).cast("int").alias("error_count"),
    )


@dataclass
class RawTables:
    accounts: DataFrame
    subscriptions: DataFrame
    feature_usage: DataFrame
    support_tickets: DataFrame
    churn_events: DataFrame


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    return RawTables(
        accounts=accounts(spark, sf_dir),
        subscriptions=subscriptions(spark, sf_dir),
        feature_usage=feature_usage(spark, sf_dir),
        support_tickets=support_tickets(spark, sf_dir),
        churn_events=churn_events(spark, sf_dir),
    )
