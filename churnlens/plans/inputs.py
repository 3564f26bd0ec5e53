"""Shared inputs for the registered queries: raw tables from the test
adapter, facts, and the panel.  Nothing here collects rows; the eager work is
the sequencer's table, one row of bounds, a row per source of horizons and an
optional stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.operators import facts
from churnlens.operators.horizon import Horizons
from churnlens.operators.panel import build_panel
from churnlens.sources.adapter import raw_tables
from churnlens.session import stored


class Facts:
    """Raw tables and facts of one input folder.  The sequenced facts are
    built on first use (building them stores the sequence), so queries
    that do not need them skip that job."""

    def __init__(self, raw):
        self.accounts: DataFrame = raw.accounts
        self.subscriptions: DataFrame = raw.subscriptions
        self.usage: DataFrame = raw.feature_usage
        self.tickets: DataFrame = raw.support_tickets
        self.churn: DataFrame = raw.churn_events
        self.tickets_fact: DataFrame = facts.tickets_fact(raw.support_tickets)
        self._sub_fact = None
        self._churn_fact = None

    @property
    def sub_fact(self) -> DataFrame:
        if self._sub_fact is None:
            self._sub_fact = facts.subscription_fact(self.subscriptions)
        return self._sub_fact

    @property
    def churn_fact(self) -> DataFrame:
        if self._churn_fact is None:
            self._churn_fact = facts.churn_fact(self.churn)
        return self._churn_fact


    def sources(self) -> dict[str, DataFrame]:
        """The raw tables by name, for the horizons."""
        return {"accounts": self.accounts, "subscriptions": self.subscriptions, "feature_usage": self.usage,
                "support_tickets": self.tickets, "churn_events": self.churn}

    def panel(self, grain: str = "quarter", observed: bool = False, **kw) -> DataFrame:
        """The account x period panel; ``observed``: labels are known as far as
        their sources have been observed, not as far as the panel goes.  Raw
        usage is pre-aggregated by the panel before the subscription map join;
        only the as-of pick reads the sequenced subscriptions."""
        horizons = Horizons.of(self.sources(), grain) if observed else None
        return build_panel(self.accounts, self.sub_fact, self.usage, self.tickets_fact, self.churn, grain=grain,
                           subscriptions=self.subscriptions, horizons=horizons, **kw)


def load_facts(spark: SparkSession, sf_dir: str) -> Facts:
    return Facts(raw_tables(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str, grain: str = "quarter", f: Facts | None = None,
          materialise: bool = False) -> DataFrame:
    """The account x period panel.  ``materialise`` cuts lineage with a
    stored table for consumers that read it several times (statistics
    passes) -- the panel job's written table, in effect."""
    p = (f or load_facts(spark, sf_dir)).panel(grain)
    return stored(p, "panel") if materialise else p
