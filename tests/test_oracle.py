"""The correctness gate on a representative subset, at the smallest scale
(the full set runs with ``python tests/compare.py`` at sf0.01)."""
import pytest

from tests.compare import compare, duck

KEYS = ["subscription_fact", "asof_subscription", "quarter_panel", "month_panel", "qoq_summary",
        "contract_flags", "feature_set", "rank_metrics", "latest_risk", "upload_multi", "scored", "driver_counts"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", KEYS)
def test_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    probs = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con)
    assert not probs, probs


def test_every_query_has_an_oracle():
    from churnlens.plans.catalog import QUERIES
    from oracle.sql import oracle_queries
    assert set(QUERIES) == set(oracle_queries())
