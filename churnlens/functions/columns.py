"""Small schema-level helpers (driver side, schema only, never data)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def require_columns(df: DataFrame, cols: Iterable[str], context: str = "input") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{context} is missing required columns: {missing}")


def keep_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep-if-present projection, in the given order, without repeats."""
    seen, out = set(), []
    for c in cols:
        if c in df.columns and c not in seen:
            seen.add(c)
            out.append(c)
    return df.select(*out)


def first_existing(df: DataFrame, candidates: Iterable[str]) -> str | None:
    for c in candidates:
        if c in df.columns:
            return c
    return None


def with_default(df: DataFrame, c: str, value, dtype: str | None = None) -> DataFrame:
    """Add column ``c`` as a literal when it is absent."""
    if c in df.columns:
        return df
    lit = F.lit(value)
    return df.withColumn(c, lit.cast(dtype) if dtype else lit)


def to_num(c, default=None) -> Column:
    """Numeric coercion: bad text becomes null, then optional default."""
    col = F.col(c) if isinstance(c, str) else c
    out = col.try_cast("double")
    if default is not None:
        out = F.coalesce(out, F.lit(float(default)))
    return out


def col_or(df: DataFrame, c: str, default) -> Column:
    """``df.get(c, default)``: the column when present, else a literal."""
    if c in df.columns:
        return F.col(c)
    return F.lit(default)


def flag(cond: Column) -> Column:
    """Three-valued condition to 0/1 int with null counted as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


EXACT_BELOW = 1e7  # times 10**6 it is known to 0.002, which leaves ties and near ties to ``round``


def round_half_up(c: Column, digits: int = 6) -> Column:
    """``F.round`` of a double, without its decimals where they decide nothing:
    a value that lies clearly to one side of a tie is the nearest whole number
    of steps, divided once.  That is the same double; near ties, large values,
    NaN and infinities go through ``F.round``."""
    steps = c * F.lit(10.0 ** digits)
    whole = F.rint(steps)
    clear = (F.abs(c) < EXACT_BELOW) & (F.abs(steps - whole) < 0.49)
    # + 0.0: a rounded zero has no sign
    return F.when(clear, whole / F.lit(10.0 ** digits) + F.lit(0.0)).otherwise(F.round(c, digits))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (for cross-engine comparisons only)."""
    out = []
    for name, dtype in df.dtypes:
        if dtype == "double":
            out.append(round_half_up(F.col(name), digits).alias(name))
        elif dtype == "float":
            out.append(F.round(F.col(name), digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
