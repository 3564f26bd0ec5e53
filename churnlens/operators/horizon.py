"""How far each source has been observed (the right-censoring horizon).

The panel's last period is no horizon: planned contract ends stretch it past
everything that has happened, and rows there hold zeros that nobody saw.  A
source is observed up to the period of its latest date; that period counts only
if the date lies in its last ``tail_days`` days, so that a period cut short by
the extract is left out.  Contract ends are plans and no observation.

A quarter's label needs the churn events of the next quarter(s) and the
quarter's own usage and tickets, so it is known up to the least of these.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.periods import period_end, period_index, period_label

TAIL_DAYS = 31
#: source -> column whose dates have been observed
OBSERVED_DATES = {"accounts": "signup_date", "subscriptions": "start_date", "feature_usage": "usage_date",
                  "support_tickets": "submitted_at", "churn_events": "churn_date"}
LABEL_SOURCE = "churn_events"
FEATURE_SOURCES = ("feature_usage", "support_tickets")


def source_horizons(sources: dict[str, DataFrame], grain: str = "quarter", tail_days: int = TAIL_DAYS) -> DataFrame:
    """One row per source: dated rows, first and last date, and the first and
    last observed period (index and label; null without any date)."""
    rows = []
    for name, column in OBSERVED_DATES.items():
        if name in sources and column in sources[name].columns:
            d = F.to_date(F.col(column))
            rows.append(sources[name].agg(F.count(d).alias("n_dates"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))
                        .select(F.lit(name).alias("source"), "*"))
    if not rows:
        raise ValueError("no source has a date column, so no horizon can be found")
    every = reduce(lambda a, b: a.unionByName(b), rows)
    last = period_index("last_date", grain)
    whole = F.col("last_date") > F.date_sub(period_end(last, grain), tail_days)
    out = every.select("*", period_index("first_date", grain).alias("observed_from_idx"),
                       F.when(whole, last).otherwise(last - 1).alias("observed_until_idx"))
    return out.select("*", period_label("observed_from_idx", grain).alias("observed_from"),
                      period_label("observed_until_idx", grain).alias("observed_until"))


@dataclass(frozen=True)
class Horizons:
    """Last observed period index per source (null: never observed)."""
    until: dict[str, int | None]

    @staticmethod
    def of(sources: dict[str, DataFrame], grain: str = "quarter", tail_days: int = TAIL_DAYS) -> "Horizons":
        rows = source_horizons(sources, grain, tail_days).select("source", "observed_until_idx").collect()  # a row per source
        return Horizons({r["source"]: r["observed_until_idx"] for r in rows})

    def observed(self, source: str, idx: Column) -> Column:
        """Whether ``source`` is observed in period ``idx``; a source that the input lacks hides nothing."""
        if source not in self.until:
            return F.lit(True)
        last = self.until[source]
        return F.lit(False) if last is None else idx <= F.lit(int(last))

    def label_known(self, idx: Column, ahead: int) -> Column:
        """Whether the label of period ``idx`` over the next ``ahead`` periods is known."""
        known = self.observed(LABEL_SOURCE, idx + ahead)
        return reduce(lambda a, b: a & b, [self.observed(s, idx) for s in FEATURE_SOURCES], known)
