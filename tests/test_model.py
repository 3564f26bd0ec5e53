"""The fitted model satisfies the optimality conditions of the documented
objective: C * sum(w_i * logloss_i) + (1 - a) / 2 * |b|^2 + a * |b|_1."""
import numpy as np
from pyspark.sql import functions as F

from churnlens.operators import metrics, model
from churnlens.plans.catalog import LABEL, feature_frame


def test_elastic_net_kkt(spark):
    s = metrics.time_split(feature_frame(spark, "/root/testdata/sf0.01"), LABEL)
    train = s.where(F.col("split") == "train").cache()
    spec = model.fit_logistic(train, LABEL)
    cols = [spec.transformed(t).alias(t.name) for t in spec.terms]
    pdf = train.select(*cols, F.col(LABEL).cast("double").alias("y")).toPandas()  # test-only, small
    X = pdf[[t.name for t in spec.terms]].to_numpy()
    y = pdf["y"].to_numpy()
    w = np.where(y == 1, 2.0, 1.0)
    beta = np.array([t.coef for t in spec.terms])
    p = 1 / (1 + np.exp(-(spec.intercept + X @ beta)))
    W = w.sum()
    lam, a = 1.0 / (model.DEFAULT_PARAMS["C"] * W), model.DEFAULT_PARAMS["l1_ratio"]
    g = (X.T @ (w * (p - y))) / W + lam * (1 - a) * beta
    resid = np.where(beta != 0, np.abs(g + lam * a * np.sign(beta)), np.maximum(np.abs(g) - lam * a, 0))
    assert abs((w * (p - y)).sum() / W) < 1e-4
    assert resid.max() < 1e-4


def test_spec_roundtrip(spark, tmp_dir):
    spec = model.fixed_scorer()
    model.save_spec(spark, spec, f"{tmp_dir}/spec")
    back = model.load_spec(spark, f"{tmp_dir}/spec")
    assert back.to_json() == spec.to_json()
