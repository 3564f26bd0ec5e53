"""Panel quality checks (M1-M5) as small aggregate DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import first_existing

QUARTER_CANDIDATES = ["quarter_end", "quarter", "acct_quarter", "account_quarter", "qtr"]
LABELS = ["account_churn_event_in_next_quarter", "churn_label_q2_rolling"]
CORE = ["usage_count", "tickets_opened", "arr_amount", "seats"]


def quarter_column(df: DataFrame) -> str:
    c = first_existing(df, QUARTER_CANDIDATES)
    if c is None:
        raise ValueError(f"none of {QUARTER_CANDIDATES} is a column of the panel")
    return c


def panel_shape(df: DataFrame) -> DataFrame:
    """M1: rows, columns, distinct accounts, distinct quarters."""
    q = quarter_column(df)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"),
                  F.countDistinct("account_id").alias("n_accounts"),
                  F.countDistinct(F.col(q).cast("string")).alias("n_quarters"))


def label_rate(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """M2: mean label and usable rows (label not null), one row per label."""
    rows = [F.struct(F.lit(lb).alias("label"), F.col(lb).cast("double").alias("v")) for lb in labels if lb in df.columns]
    long = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return long.groupBy("label").agg(F.avg("v").alias("rate"), F.count("v").alias("n"))


def label_rate_by_quarter(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """M3: rate and n per quarter on usable rows."""
    q = quarter_column(df)
    rows = [F.struct(F.lit(lb).alias("label"), F.col(lb).cast("double").alias("v")) for lb in labels if lb in df.columns]
    long = df.select(F.col(q).alias("quarter_key"), F.explode(F.array(*rows)).alias("x")) \
        .select("quarter_key", "x.*").where(F.col("v").isNotNull())
    return long.groupBy("label", "quarter_key").agg(F.avg("v").alias("rate"), F.count("v").alias("n"))


def missing_rates(df: DataFrame, cols: list[str] = CORE) -> DataFrame:
    """M4: share of nulls per core column (absent columns are reported absent)."""
    present = [c for c in cols if c in df.columns]
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in present])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_rate")) for c in present])
    return row.select(F.explode(arr).alias("x")).select("x.*")


def duplicate_keys(df: DataFrame) -> DataFrame:
    """M5: rows beyond the first per (account_id, quarter)."""
    q = quarter_column(df)
    g = df.groupBy("account_id", q).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
