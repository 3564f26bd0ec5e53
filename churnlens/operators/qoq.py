"""Robust quarter-over-quarter transform.

For every numeric ``*_qoq_delta`` / ``*_qoq_change`` column: winsorise to the
exact [p1, p99] (linear interpolation, nulls skipped), z-score the clipped
value with the *population* std (std 0 or undefined -> 0.0 for every row),
and a sign flag.  Two 1-row statistics passes; the final row is fetched once
and inlined as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.operators.stats import quantile_row

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def qoq_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose name contains ``_qoq_delta`` or ``_qoq_change``."""
    return [f.name for f in df.schema.fields
            if ("_qoq_delta" in f.name or "_qoq_change" in f.name) and isinstance(f.dataType, NUMERIC)]


def qoq_statistics(df: DataFrame, cols: list[str] | None = None, method: str = "exact") -> dict:
    """Per column p1, p99, mean / population std of the clipped value and
    the share of negative raw values.  Two aggregate passes whose one-row
    results are fetched and kept as plain numbers (inlined later as
    literals, so no plan recomputes them)."""
    cols = cols if cols is not None else qoq_columns(df)
    if not cols:
        return {}
    q = quantile_row(df, cols, [0.01, 0.99], method).first().asDict()
    stats = {}
    for c in cols:
        stats[f"{c}__p1"], stats[f"{c}__p99"] = q[f"{c}__q0"], q[f"{c}__q1"]
    clipped = [_clip(c, _lit(stats[f"{c}__p1"]), _lit(stats[f"{c}__p99"])).alias(c) for c in cols]
    m = df.select(*clipped, *[F.col(c).alias(f"_raw_{c}") for c in cols]).agg(
        *[F.avg(c).alias(f"{c}__mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}__std") for c in cols],
        *[F.avg(F.coalesce(F.col(f"_raw_{c}") < 0, F.lit(False)).cast("double")).alias(f"{c}__pct_negative")
          for c in cols]).first().asDict()
    stats.update(m)
    return stats


def _lit(v):
    return F.lit(v).cast("double")


def _clip(c: str, lo=None, hi=None):
    v = F.col(c).cast("double")
    lo = F.col(f"{c}__p1") if lo is None else lo
    hi = F.col(f"{c}__p99") if hi is None else hi
    # plain least/greatest skip nulls and would invent values: guard the null
    return F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))


def qoq_transform(df: DataFrame, cols: list[str] | None = None, method: str = "exact",
                  stats: dict | None = None) -> DataFrame:
    """Add ``_clipped``, ``_z`` and ``_drop_flag`` per QoQ column."""
    cols = cols if cols is not None else qoq_columns(df)
    if not cols:
        return df
    row = stats if stats is not None else qoq_statistics(df, cols, method)
    add = []
    for c in cols:
        lit = lambda k: F.lit(row[f"{c}__{k}"]).cast("double")
        clipped = _clip(c, lit("p1"), lit("p99"))
        std = row[f"{c}__std"]
        if std is None or std != std or std == 0:
            z = F.lit(0.0)
        else:
            z = (clipped - lit("mean")) / F.lit(float(std))
        add += [clipped.alias(f"{c}_clipped"), z.alias(f"{c}_z"),
                F.coalesce(F.col(c) < 0, F.lit(False)).cast("int").alias(f"{c}_drop_flag")]
    return df.select(*[F.col(c) for c in df.columns], *add)


def qoq_summary(spark, stats: dict, cols: list[str]) -> DataFrame:
    """Per feature p1, p99, mean and population std of the clipped value,
    share of negative raw deltas (over all rows) -- one row per feature."""
    rows = [(c, stats[f"{c}__p1"], stats[f"{c}__p99"], stats[f"{c}__mean"], stats[f"{c}__std"],
             stats[f"{c}__pct_negative"]) for c in cols]
    return spark.createDataFrame(rows, "feature string, p1 double, p99 double, mean_clipped double, "
                                       "std_clipped double, pct_negative double")
