"""Calendar operators: global date range, period calendar, account spine.

The range is a one-row aggregate (min/max per table, read from one column
each so parquet prunes everything else); it is joined back as a broadcast of
that single row -- a proven size bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.periods import period_end, period_index, period_label, period_start

PERIOD_NAMES = {
    "quarter": ("quarter", "quarter_start", "quarter_end"),
    "month": ("period", "period_start", "period_end"),
}


def date_range(accounts: DataFrame, sub_fact: DataFrame, usage: DataFrame,
               tickets: DataFrame, churn: DataFrame) -> DataFrame:
    """D3: one row (min_date, max_date) over signup, usage, submitted, start,
    end and churn dates.  Future contract ends count, so they stretch it."""
    sources = [(accounts, "signup_date"), (usage, "usage_date"), (tickets, "submitted_at"),
               (sub_fact, "start_date"), (sub_fact, "end_date"), (churn, "churn_date")]
    parts = []
    for df, c in sources:
        if c in df.columns:
            d = F.to_date(F.col(c))
            parts.append(df.agg(F.min(d).alias("lo"), F.max(d).alias("hi")))
    if not parts:
        raise ValueError("no table has a single readable date, so there is no period to build")
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.agg(F.min("lo").alias("min_date"), F.max("hi").alias("max_date"))


def period_bounds(rng: DataFrame, grain: str) -> DataFrame:
    """One row: first and last period index of the range."""
    return rng.select(period_index("min_date", grain).alias("min_idx"),
                      period_index("max_date", grain).alias("max_idx"))


def bounds_literals(bounds: DataFrame) -> DataFrame:
    """Fetch the one bounds row once and return it as a literal 1-row frame,
    so the plans that use it neither rescan the tables nor join a subquery."""
    r = bounds.first()
    if r is None or r["min_idx"] is None:
        raise ValueError("no table has a single readable date, so there is no period to build")
    lo, hi = (F.lit(int(r[c])).cast("int").alias(c) for c in ("min_idx", "max_idx"))
    return bounds.sparkSession.range(1, numPartitions=1).select(lo, hi)


def calendar(rng: DataFrame, grain: str = "quarter") -> DataFrame:
    """Every period of the range with label, start and end (DATE)."""
    label, start, end = PERIOD_NAMES[grain]
    b = period_bounds(rng, grain)
    idx = b.select(F.explode(F.sequence("min_idx", "max_idx")).alias("p_idx"))
    return idx.select(period_label("p_idx", grain).alias(label),
                      period_start("p_idx", grain).alias(start),
                      period_end("p_idx", grain).alias(end))


def account_spine(accounts: DataFrame, bounds: DataFrame, grain: str = "quarter", single: bool = False) -> DataFrame:
    """(account_id, signup_date, p_idx) for every period whose end is on or
    after signup, up to the last period.  Dropped periods are never built;
    a null signup drops the account.

    ``single``: an account that has several signups is one row a period, with the
    latest signup so far; accounts are then dealt by ``account_id`` before their
    periods are built, so that no built row is shuffled."""
    a = accounts.select("account_id", F.to_date("signup_date").alias("signup_date")) \
        .where(F.col("signup_date").isNotNull())
    lo = F.greatest(period_index("signup_date", grain), F.col("min_idx"))
    hi = F.col("max_idx")
    if single:
        w = Window.partitionBy("account_id").orderBy("signup_date")
        a = a.distinct().select("*", F.lead("signup_date").over(w).alias("_next"))
        later = F.greatest(period_index("_next", grain), F.col("min_idx"))
        hi = F.when(F.col("_next").isNull(), hi).otherwise(F.least(hi, later - 1))
    j = a.crossJoin(F.broadcast(bounds))
    seq = F.when(hi >= lo, F.sequence(lo, hi))
    return j.select("account_id", "signup_date", F.explode(seq).alias("p_idx"))
