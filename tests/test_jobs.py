"""Ingest, train and score jobs through their written files."""
import datetime as dt
import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from churnlens.operators import explain, flags, model, report, risk, upload
from churnlens.plans import catalog, jobs
from churnlens.sources import aliases, raw

SF = "/root/testdata/sf0.01"
TODAY = dt.date(2001, 6, 30)


def test_train_job_writes_a_model_that_scores_the_same(spark, tmp_dir):
    table = catalog.feature_frame(spark, SF, observed=True)
    spec = jobs.train_job(table, f"{tmp_dir}/run")
    assert sorted(os.listdir(f"{tmp_dir}/run")) == sorted([
        "coefficients", "cv_folds", "cv_summary", "demo_output", "latest_risk", "metrics", "model", "optimality", "preprocessing", "validation_report"])
    loaded = jobs.load_model(spark, [f"{tmp_dir}/absent", f"{tmp_dir}/run/model"])
    assert loaded.to_json() == spec.to_json()
    read = lambda n: spark.read.option("header", True).csv(f"{tmp_dir}/run/{n}")
    direct = {r.account_id: r for r in risk.latest_risk_output(table, spec).collect()}
    stored = read("latest_risk").collect()
    assert len(stored) == len(direct) and all(abs(float(r.churn_prob_q1) - direct[r.account_id].churn_prob_q1) < 1e-12 for r in stored)
    assert 0.5 < float(read("metrics").first().validation_auc) < 1 and {r.optimal for r in read("optimality").collect()} == {"true"}
    strength = [round(float(r.abs_coefficient), 9) for r in sorted(read("coefficients").collect(), key=lambda r: int(r.position))]
    assert strength == sorted(strength, reverse=True)


def test_load_model_errors(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        jobs.load_model(spark, [f"{tmp_dir}/a", f"{tmp_dir}/b"])


def single(spark):
    rows = [("a", "Pro", 10, 20, 3, 1, 30, 2.0), ("b", "Basic", 30, 20, 0, 0, 400, 5.0), ("c", "Pro", 5, 5, 9, 1, None, None)]
    return spark.createDataFrame(rows, "customerid string, plan string, usage_current int, usage_prev int, tickets_current int, tickets_prev int, "
                                       "days_to_end_current int, csat_current double")


def test_score_job_single_resolves_headers_and_writes(spark, tmp_dir):
    jobs.write_table(single(spark), f"{tmp_dir}/up", fmt="csv")
    model.save_spec(spark, model.fixed_scorer(), f"{tmp_dir}/model")
    out = jobs.score_job(spark, "single", {"single": f"{tmp_dir}/up"}, [f"{tmp_dir}/model"], TODAY, f"{tmp_dir}/out")
    want = {r.account_id: r.risk_probability for r in explain.score(upload.build_from_single(single(spark), TODAY), model.fixed_scorer()).collect()}
    got = {r.account_id: r.risk_probability for r in out["scored"].collect()}
    assert got == pytest.approx(want) and len(got) == 3
    assert spark.read.option("header", True).csv(f"{tmp_dir}/out/scored").count() == 3
    assert int(spark.read.option("header", True).csv(f"{tmp_dir}/out/kpis").first().rows_scored) == 3
    low = jobs.score_job(spark, "single", {"single": f"{tmp_dir}/up"}, [f"{tmp_dir}/model"], TODAY, high=0.0, medium=0.0)
    assert low["kpis"].first().high_risk == 3


def test_score_job_quarterly_renews_history(spark, tmp_dir):
    q = "account_id string, as_of_quarter string, usage_count_total int, ticket_count int, plan_tier string"
    hist = spark.createDataFrame([("a", "2024-01-01", 50, 1, "Pro"), ("a", "2023-10-01", 70, 1, "Pro"), ("b", "2024-01-01", 5, 0, "Basic")], q)
    new = spark.createDataFrame([("a", "2024-04-01", 10, 4, "Pro"), ("b", "2024-04-01", 6, 0, "Basic"), ("a", "2024-04-01", 11, 4, "Pro")], q).coalesce(1)
    for n, df in (("history", hist), ("new", new)):
        jobs.write_table(df, f"{tmp_dir}/{n}", fmt="csv")
    model.save_spec(spark, model.fixed_scorer(), f"{tmp_dir}/model")
    paths = {n: f"{tmp_dir}/{n}" for n in ("history", "new")}
    out = jobs.score_job(spark, "quarterly", paths, [f"{tmp_dir}/model"], TODAY, f"{tmp_dir}/out")
    a = out["scored"].where("account_id = 'a'").first()
    assert a.risk_type == "Usage" and a.usage_count_total == 11 and a.hist_usage_median == 60
    kept = {(r.account_id, str(r.as_of_quarter)): r.usage_count_total for r in spark.read.parquet(f"{tmp_dir}/out/history").collect()}
    assert kept == {("a", "2023-10-01"): 70, ("a", "2024-01-01"): 50, ("a", "2024-04-01"): 11, ("b", "2024-01-01"): 5, ("b", "2024-04-01"): 6}
    with pytest.raises(ValueError, match="not given"):
        jobs.score_job(spark, "multi", {"accounts": "x"}, [], TODAY)
    with pytest.raises(ValueError, match="no such mode"):
        jobs.score_job(spark, "weekly", {}, [], TODAY)


def test_ingest_counts_what_it_refuses(spark, tmp_dir):
    lines = ["ticket_id, account_id ,submitted_at,satisfaction_score,escalation_flag", "t1,a,2024-01-05 10:00:00,4,true", "t2,,2024-01-05,9x,maybe",
             "t3,a,yesterday,,false", "t4,b,,3,", "t5,\"  \",2024-02-30,1,true"]
    with open(f"{tmp_dir}/t.csv", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    rejects = {(r.column, r.reason): r.n for r in jobs.ingest_job(spark, {"support_tickets": f"{tmp_dir}/t.csv"}, f"{tmp_dir}/out").collect()}
    assert rejects[("submitted_at", raw.BAD_VALUE)] == 2 and rejects[("satisfaction_score", raw.BAD_VALUE)] == 1
    assert rejects[("escalation_flag", raw.BAD_VALUE)] == 1 and rejects[("account_id", raw.MISSING_ID)] == 2
    rows = {r.ticket_id: r for r in spark.read.parquet(f"{tmp_dir}/out/support_tickets").collect()}
    assert set(rows) == {"t1", "t3", "t4"} and rows["t3"].submitted_at is None and rows["t1"].satisfaction_score == 4
    own = raw.Ingest(spark.read.option("header", True).csv(f"{tmp_dir}/t.csv"), "support_tickets")
    assert {(r.column, r.reason): r.n for r in own.rejects.collect()} == rejects
    assert {r.ticket_id: sorted(r.at_fault) for r in own.refused.collect()} == {
        "t2": ["account_id", "escalation_flag", "satisfaction_score"], "t3": ["submitted_at"], "t5": ["account_id", "submitted_at"]}
    seen = Observation("empty")
    none = raw.Ingest(spark.createDataFrame([], "account_id string, signup_date string"), "accounts")
    assert none.observed(seen).count() == 0 and raw.observed_rejects(spark, none, seen).where("n > 0").count() == 0


def test_substring_headers_are_opt_in():
    assert aliases.find_in_context(["account_id", "status"], "ticket_id", "tickets") is None
    assert aliases.find_in_context(["support_ticket_id_no", "status"], "ticket_id", "tickets", substring=True) == "support_ticket_id_no"


def test_resolve_headers_serves_each_header_once(spark):
    df = spark.createDataFrame([("t", "a", "2024-01-01", 1)], "case_id string, customerid string, `Created At` string, rating int")
    assert aliases.resolve_headers(df, "tickets").columns == ["ticket_id", "account_id", "submitted_at", "satisfaction_score"]


def test_safe_mode_without_core_columns(spark):
    feats = spark.createDataFrame([("a", 3.0)], "account_id string, seats double")
    r = explain.score(feats, model.fixed_scorer()).first()
    assert (r.risk_type, r.drivers) == ("Unknown", explain.TXT["safe_drivers"]) and 0 < r.risk_probability < 1
    full = spark.createDataFrame([("a", 0.0, 0.0, 1.0, "Pro")], "account_id string, usage_count_qoq_delta_z double, "
                                 "tickets_opened_qoq_delta_z double, days_to_contract_end_capped double, plan_tier string")
    with pytest.raises(ValueError, match="missing required columns"):
        explain.score(full, model.fixed_scorer())


def test_contract_lookup_and_its_duplicate_error(spark):
    panel = spark.createDataFrame([("a", "s1", None), ("b", "s2", "2024-05-01"), ("c", None, None)],
                                  "account_id string, subscription_id_asof_qend string, d string") \
        .select("account_id", "subscription_id_asof_qend", F.to_date("d").alias("end_date_inferred"))
    fact = spark.createDataFrame([("s1", "2024-03-01", None), ("s2", None, "2024-06-01")], "subscription_id string, e string, i string") \
        .select("subscription_id", F.to_date("e").alias("end_date"), F.to_date("i").alias("end_date_inferred"))
    got = {r.account_id: (str(r.effective_end_date), r.contract_end_observed_flag, r.contract_end_inferred_flag)
           for r in flags.add_contract_flags(panel, fact).collect()}
    assert got == {"a": ("2024-03-01", 1, 0), "b": ("2024-05-01", 0, 1), "c": ("None", 0, 0)}
    with pytest.raises(ValueError, match="not unique"):
        flags.add_contract_flags(panel, fact.unionByName(fact.limit(1)))


def test_export_drops_display_columns(spark, tmp_dir):
    df = spark.createDataFrame([("a", "1%", 2)], "account_id string, risk_probability_pct string, _tier_order int")
    report.export_scored(df, f"{tmp_dir}/x")
    assert spark.read.option("header", True).csv(f"{tmp_dir}/x").columns == ["account_id"]


def test_spec_survives_json(spark, tmp_dir):
    model.save_spec(spark, model.fixed_scorer(), f"{tmp_dir}/m")
    assert json.loads(jobs.load_model(spark, [f"{tmp_dir}/m"]).to_json()) == json.loads(model.fixed_scorer().to_json())


def test_second_job_reads_a_stage_without_an_exchange(spark, tmp_dir):
    from churnlens.operators.panel import latest_snapshot
    from churnlens.plans.inputs import panel
    p = panel(spark, "/root/testdata/sf0.001", "quarter").cache()
    first = jobs.Stage("stage_under_test", f"{tmp_dir}/stage", 5)
    first.write(p)
    spark.sql("drop table stage_under_test")  # the second job's catalog does not know it; the files stay
    snap = latest_snapshot(jobs.Stage("stage_under_test", f"{tmp_dir}/stage", 5).open(spark), "quarter_end")
    plan = snap._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" in latest_snapshot(p, "quarter_end")._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, snap.collect())) == sorted(map(str, latest_snapshot(p, "quarter_end").collect()))
    assert len([f for f in os.listdir(f"{tmp_dir}/stage") if f.endswith(".parquet")]) <= 5
    spark.sql("drop table stage_under_test")
