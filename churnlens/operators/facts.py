"""Fact builders (subscription, usage, tickets, churn).

Ties the source leaves to file order are broken on the primary key, so every
result is deterministic and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import keep_present
from churnlens.operators.ordered import sequence_within

SUBSCRIPTION_FACT_COLUMNS = [
    "account_id", "subscription_id", "start_date", "end_date", "end_date_inferred",
    "next_start_date", "subscription_seq",
    "plan_tier", "seats", "mrr_amount", "arr_amount", "billing_frequency",
    "is_trial", "auto_renew_flag", "upgrade_flag", "downgrade_flag", "churn_flag",
]


def subscription_fact(subs: DataFrame) -> DataFrame:
    """Per-account sequence by start date, next start, inferred end.

    ``end_date_inferred`` = end_date, else the next subscription's start
    (half-open interval).  Sequencing is skew-safe: a hot account is split
    over several range partitions (see ``sequence_within``).
    """
    seq = sequence_within(
        subs,
        key_cols=["account_id"],
        order_cols=[F.col("start_date").asc_nulls_last(), F.col("subscription_id").asc()],
        seq_col="subscription_seq",
        lead_cols={"start_date": "next_start_date"},
    )
    out = seq.withColumn("end_date_inferred", F.coalesce(F.col("end_date"), F.col("next_start_date")))
    out = keep_present(out, SUBSCRIPTION_FACT_COLUMNS)
    if "churn_flag" in out.columns:
        out = out.withColumnRenamed("churn_flag", "subscription_cancel_flag")
    return out


def usage_fact(usage: DataFrame, sub_fact: DataFrame) -> DataFrame:
    """Every usage row, plus its account through the subscription map."""
    mapping = sub_fact.select("subscription_id", "account_id").distinct()
    return usage.join(mapping, "subscription_id", "left")


def tickets_fact(tickets: DataFrame) -> DataFrame:
    """Floor submitted/closed timestamps to the day."""
    out = tickets
    if "submitted_at" in out.columns:
        out = out.withColumn("submitted_date", F.date_trunc("day", F.col("submitted_at")).cast("timestamp_ntz"))
    if "closed_at" in out.columns:
        out = out.withColumn("closed_date", F.date_trunc("day", F.col("closed_at")).cast("timestamp_ntz"))
    return out


def churn_fact(churn: DataFrame) -> DataFrame:
    """``churn_seq`` by churn date within the account (tie: event id)."""
    return sequence_within(
        churn,
        key_cols=["account_id"],
        order_cols=[F.col("churn_date").asc_nulls_last(), F.col("churn_event_id").asc()],
        seq_col="churn_seq",
    )
