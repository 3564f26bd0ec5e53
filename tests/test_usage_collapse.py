"""Usage reaches the panel's collapse as one row per account and period, added up by hash aggregates."""

from churnlens.operators import panel as pn
from churnlens.plans.inputs import load_facts
from tests.compare import _rows
from tests.conftest import SF_SMALL


def test_usage_in_account_is_usage_by_period(spark):
    f = load_facts(spark, SF_SMALL)
    for usage in (f.usage, f.usage.drop("feature_name")):
        got = pn.usage_in_account(pn.usage_rows(usage, f.subscriptions, "quarter")).toPandas()
        want = pn.usage_by_period(usage, f.subscriptions, "quarter").toPandas()[list(got.columns)]
        assert len(got) > 1000 and _rows(got) == _rows(want)


def test_panel_sorts_no_features(spark):
    plan = load_facts(spark, SF_SMALL).panel("quarter")._jdf.queryExecution().executedPlan().toString()
    sorting = [line for line in plan.splitlines() if "SortAggregate(key=" in line]
    assert sorting and not [line for line in sorting if "feature_name" in line]
