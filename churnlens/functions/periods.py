"""Calendar-period column expressions.

There is no period type in Spark, so a period is an integer index
(``year*4 + quarter-1`` or ``year*12 + month-1``) plus DATE start/end and a
text label (``2024Q1`` / ``2024-03``).  Everything is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("quarter", "month")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _per_year(grain: str) -> int:
    if grain == "quarter":
        return 4
    if grain == "month":
        return 12
    raise ValueError(f"unknown grain {grain!r}; expected one of {GRAINS}")


def period_index(d, grain: str = "quarter") -> Column:
    """Integer period index of a date/timestamp column (null stays null)."""
    d = _col(d)
    if grain == "quarter":
        return (F.year(d) * 4 + F.quarter(d) - 1).cast("int")
    _per_year(grain)
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


def period_start(idx, grain: str = "quarter") -> Column:
    idx = _col(idx)
    n = _per_year(grain)
    months_per = 12 // n
    year = F.floor(idx / n).cast("int")
    month = (F.pmod(idx, F.lit(n)) * months_per + 1).cast("int")
    return F.make_date(year, month, F.lit(1))


def period_end(idx, grain: str = "quarter") -> Column:
    months_per = 12 // _per_year(grain)
    return F.last_day(F.add_months(period_start(idx, grain), months_per - 1))


def period_label(idx, grain: str = "quarter") -> Column:
    idx = _col(idx)
    n = _per_year(grain)
    year = F.floor(idx / n).cast("int").cast("string")
    part = (F.pmod(idx, F.lit(n)) + 1).cast("int")
    if grain == "quarter":
        return F.concat(year, F.lit("Q"), part.cast("string"))
    return F.concat(year, F.lit("-"), F.lpad(part.cast("string"), 2, "0"))


def label_to_index(label, grain: str = "quarter") -> Column:
    """Parse ``2024Q1`` / ``2024-03`` back to the integer index."""
    label = _col(label)
    if grain == "quarter":
        y = F.substring_index(label, "Q", 1).cast("int")
        q = F.substring_index(label, "Q", -1).cast("int")
        return (y * 4 + q - 1).cast("int")
    y = F.substring(label, 1, 4).cast("int")
    m = F.substring(label, 6, 2).cast("int")
    return (y * 12 + m - 1).cast("int")


def quarter_start_of(d) -> Column:
    """Normalise any date to its quarter start (DATE)."""
    return F.trunc(_col(d), "quarter")


def quarter_end_of(d) -> Column:
    """Normalise any date to its quarter end (DATE, midnight)."""
    return F.last_day(F.add_months(F.trunc(_col(d), "quarter"), 2))


def within_period_cut(ts, grain: str = "quarter", last_day_full: bool = False) -> Column:
    """True when a timestamp counts inside its own period.

    A period ends at midnight of its last day.  Timestamps later on that last
    day fall in no period (``<= period_end`` at midnight); ``last_day_full``
    lifts that cut.
    """
    ts = _col(ts)
    if last_day_full:
        return ts.isNotNull()
    day = F.to_date(ts)
    end = period_end(period_index(day, grain), grain)
    at_midnight = ts.cast("timestamp_ntz") == day.cast("timestamp_ntz")
    return (day != end) | at_midnight
