"""Evaluation on observed labels, side-by-side fits, selection of quantiles."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import fit, horizon, metrics, model, stats
from churnlens.plans import catalog, jobs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def split(spark):
    return catalog.train_split(spark, SF).cache()


def test_last_labelled_quarters_hold_both_classes(split):
    rows = split.where("split = 'valid'").groupBy("quarter").agg(F.sum(catalog.LABEL).alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    assert len(rows) == 2 and all(0 < r.pos < r.n for r in rows)


def test_metrics_are_not_empty(spark, split):
    m = jobs.metrics_row(jobs.validation_scores(split, jobs.fit_model(split))).first()
    assert 0 < m.validation_auc < 1 and m.lift_top10 > 1 and 0 < m.recall_top5 < m.recall_top20 < 1 and m.best_precision_k > 1
    curve = catalog.QUERIES["observed_threshold_curve"](spark, SF).collect()
    assert any(0 < r.precision < 1 and 0 < r.recall < 1 for r in curve)


def test_folds_run_and_equal_single_fits(spark, split):
    folds = model.timeseries_folds(split, catalog.LABEL, 5).collect()
    assert len([r for r in folds if not r.skipped]) >= 3 and all(0 < r.auc < 1 for r in folds)
    q = max(f["q"] for f in model.fold_conditions(split, catalog.LABEL, 5))
    alone = fit.fit_side_by_side(split.where(F.col("_q_idx") < q), {"x": F.lit(True)}, catalog.LABEL)["x"]
    v = split.where(F.col("_q_idx") == q).select(F.col(catalog.LABEL).alias("label"), alone.probability().alias("p")).collect()
    pos, neg = [r.p for r in v if r.label == 1], [r.p for r in v if r.label == 0]
    pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))  # every pair
    assert abs(next(r.auc for r in folds if r.n_train == split.where(F.col("_q_idx") < q).count()) - pairs) < 1e-9
    s = model.cv_summary(model.timeseries_folds(split, catalog.LABEL, 5)).first()
    assert s.ts_cv_folds >= 3 and s.ts_cv_auc_min < s.ts_cv_auc_mean < s.ts_cv_auc_max


def test_fit_is_optimal_and_independent_of_start_and_partitions(split):
    train = split.where("split = 'train'")
    warm = jobs.fit_model(split)
    cold = fit.fit_side_by_side(train.repartition(3), {"x": F.lit(True)}, catalog.LABEL)["x"]
    assert max(abs(a.coef - b.coef) for a, b in zip(warm.terms, cold.terms)) < 1e-10
    assert all(r.optimal for r in fit.optimality(train, cold, catalog.LABEL).collect())
    moved = model.LinearSpec.from_json(cold.to_json())
    moved.terms[0].coef += 1e-3
    assert not all(r.optimal for r in fit.optimality(train, moved, catalog.LABEL).collect())


def test_preprocessors_equal_the_single_fit(split):
    train = split.where("split = 'train'")
    a, b = model.fit_preprocessor(train), fit.preprocessors(train, {"x": F.lit(True)})["x"]
    assert [t.name for t in a] == [t.name for t in b]
    assert all(x.impute == y.impute and abs(x.mean - y.mean) < 1e-9 and abs(x.scale - y.scale) < 1e-9 for x, y in zip(a, b))


def test_fold_with_one_class_has_no_model(split):
    got = fit.fit_side_by_side(split, {"none": F.lit(False), "neg": F.col(catalog.LABEL) == 0, "all": F.lit(True)}, catalog.LABEL)
    assert set(got) == {"all"}


def test_horizon_rule(spark):
    def table(column, *days):
        return spark.createDataFrame([(d,) for d in days], f"{column} string").select(F.to_date(column).alias(column))
    src = {"churn_events": table("churn_date", "2024-02-01", "2024-05-15"), "feature_usage": table("usage_date", "2024-03-31", None),
           "support_tickets": table("submitted_at", None), "accounts": table("signup_date", "2023-11-30")}
    got = {r.source: (r.observed_from, r.observed_until) for r in horizon.source_horizons(src).collect()}
    assert got == {"churn_events": ("2024Q1", "2024Q1"), "feature_usage": ("2024Q1", "2024Q1"), "support_tickets": (None, None),
                   "accounts": ("2023Q4", "2023Q3")}
    h = horizon.Horizons.of(src)
    idx = 2024 * 4
    row = spark.range(1).select(h.observed("churn_events", F.lit(idx)).alias("a"), h.observed("churn_events", F.lit(idx + 1)).alias("b"),
                                h.observed("support_tickets", F.lit(idx)).alias("c"), h.observed("subscriptions", F.lit(idx)).alias("d"),
                                h.label_known(F.lit(idx - 1), 1).alias("e")).first()
    assert tuple(row) == (True, False, False, True, False)  # tickets were never observed, so no label is known
    with pytest.raises(ValueError):
        horizon.source_horizons({})


def test_grouped_auc_equals_pairs(spark):
    r = np.random.default_rng(4)
    rows = [(g, int(y), float(p)) for g in (1, 2, 3) for y, p in zip(r.random(80) < 0.3 if g < 3 else np.zeros(80), r.integers(0, 9, 80) / 8)]
    got = {x.g: x.auc for x in metrics.grouped_auc(spark.createDataFrame(rows, "g int, label int, p double"), "g").collect()}
    for g in (1, 2):
        pos, neg = [p for a, y, p in rows if a == g and y], [p for a, y, p in rows if a == g and not y]
        assert abs(got[g] - np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])) < 1e-12
    assert got[3] is None


def test_quantiles_by_refinement_equal_numpy(spark):
    r, n = np.random.default_rng(0), 5000
    cols = {"normal": r.normal(size=n), "ints": r.integers(-5, 6, n).astype(float), "one": np.full(n, 7.0),
            "heavy": np.exp(r.normal(size=n) * 80) * r.choice([-1, 1], n), "close": 1 + r.integers(0, 3, n) * 2.0 ** -52}
    cols["heavy"][:2] = 1e308, -1e308
    g = r.integers(0, 2, n)
    df = spark.createDataFrame([(int(a), *map(float, v), None) for a, *v in zip(g, *cols.values())],
                               "g int, " + ", ".join(f"{c} double" for c in cols) + ", empty double")
    probs = [0, .01, .5, .99, 1]
    got = {x["feature"]: list(x)[1:] for x in stats.exact_quantiles(df, [*cols, "empty"], probs).collect()}
    assert set(got) == set(cols)
    for c, v in cols.items():
        assert np.allclose(got[c], np.quantile(v, probs), rtol=1e-14)
    by = {(x["g"], x["feature"]): x["q0"] for x in stats.exact_quantiles(df, ["normal", "ints"], [.5], by=["g"]).collect()}
    assert all(np.isclose(by[k, c], np.median(cols[c][g == k])) for k in (0, 1) for c in ("normal", "ints"))
    plan = stats.unpivot_values(df, ["normal"]).groupBy("feature").count()._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
