"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the whole given tables (through the adapter) and returns a
lazy DataFrame.  Double columns are rounded to 6 places at the very end so
that cross-engine checks are not decided by summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.columns import round_doubles
from churnlens.functions.periods import period_label
from churnlens.operators import calendar as cal
from churnlens.operators import facts as fx
from churnlens.operators import panel as pn
from churnlens.plans.inputs import load_facts, panel
from churnlens.session import compile_projections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            compile_projections(spark)
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ------------------------------------------------------------- facts (C)

@register("subscription_fact")
def q_subscription_fact(spark, sf_dir):
    """C1-C4"""
    return load_facts(spark, sf_dir).sub_fact


@register("usage_fact")
def q_usage_fact(spark, sf_dir):
    """C5"""
    f = load_facts(spark, sf_dir)
    return fx.usage_fact(f.usage, f.subscriptions)


@register("tickets_fact")
def q_tickets_fact(spark, sf_dir):
    """C6"""
    return load_facts(spark, sf_dir).tickets_fact


@register("churn_fact")
def q_churn_fact(spark, sf_dir):
    """C7"""
    return load_facts(spark, sf_dir).churn_fact


# ------------------------------------------------------------- calendar

def _range(f):
    return cal.date_range(f.accounts, f.subscriptions, f.usage, f.tickets, f.churn)


@register("date_range")
def q_date_range(spark, sf_dir):
    """D3"""
    return _range(load_facts(spark, sf_dir))


@register("quarter_calendar")
def q_quarter_calendar(spark, sf_dir):
    """D2"""
    return cal.calendar(_range(load_facts(spark, sf_dir)), "quarter")


@register("month_calendar")
def q_month_calendar(spark, sf_dir):
    """D1"""
    return cal.calendar(_range(load_facts(spark, sf_dir)), "month")


@register("account_spine")
def q_account_spine(spark, sf_dir):
    """D4"""
    f = load_facts(spark, sf_dir)
    s = cal.account_spine(f.accounts, cal.period_bounds(_range(f), "quarter"), "quarter")
    return s.select("account_id", "signup_date", period_label("p_idx", "quarter").alias("quarter"))


# ------------------------------------------------------------- period aggregates

@register("usage_by_quarter")
def q_usage_by_quarter(spark, sf_dir):
    """D5"""
    f = load_facts(spark, sf_dir)
    u = pn.usage_by_period(f.usage, f.subscriptions, "quarter")
    return u.select("account_id", period_label("p_idx", "quarter").alias("quarter"),
                    "active_days", "usage_count", "usage_hours", "errors", "features_used")


@register("tickets_by_quarter")
def q_tickets_by_quarter(spark, sf_dir):
    """D6 (midnight cut on the last day kept)"""
    t = pn.tickets_by_period(load_facts(spark, sf_dir).tickets_fact, "quarter")
    return t.select("account_id", period_label("p_idx", "quarter").alias("quarter"),
                    "tickets_opened", "escalations", "avg_satisfaction")


@register("asof_subscription")
def q_asof_subscription(spark, sf_dir):
    """Subscription in force at each quarter end, inside the panel range"""
    f = load_facts(spark, sf_dir)
    a = pn.asof_subscription(f.sub_fact, cal.period_bounds(_range(f), "quarter"), "quarter")
    return a.select("account_id", period_label("p_idx", "quarter").alias("quarter"),
                    F.col("asof.subscription_id").alias("subscription_id_asof_qend"),
                    "asof.plan_tier", F.col("asof.seats").cast("double").alias("seats"),
                    "asof.mrr_amount", "asof.arr_amount", "asof.billing_frequency", "asof.end_date_inferred")


@register("churn_labels")
def q_churn_labels(spark, sf_dir):
    """Churn events seen from each (account, quarter); non-empty rows"""
    c = pn.churn_by_period(load_facts(spark, sf_dir).churn, "quarter")
    return c.select("account_id", period_label("p_idx", "quarter").alias("quarter"),
                    F.col("churn_in").alias("account_churn_event_count_in_quarter"),
                    F.col("churn_next").alias("account_churn_event_count_in_next_quarter"),
                    (F.col("churn_next2") > 0).alias("account_churn_event_in_second_next_quarter"))


@register("subscription_end_labels")
def q_subscription_end_labels(spark, sf_dir):
    """D11"""
    e = pn.subscription_ends_by_period(load_facts(spark, sf_dir).subscriptions, "quarter")
    return e.select("account_id", period_label("p_idx", "quarter").alias("quarter"),
                    F.col("ends_in").alias("subscription_ends_in_quarter"),
                    F.col("ends_next").alias("subscription_ends_in_next_quarter"))


# ------------------------------------------------------------- panels

@register("quarter_panel")
def q_quarter_panel(spark, sf_dir):
    """D31"""
    return panel(spark, sf_dir, "quarter")


@register("month_panel")
def q_month_panel(spark, sf_dir):
    """D30"""
    return panel(spark, sf_dir, "month")


@register("latest_snapshot_quarter")
def q_latest_snapshot_quarter(spark, sf_dir):
    """D29"""
    return pn.latest_snapshot(panel(spark, sf_dir, "quarter"), "quarter_end")


@register("latest_snapshot_month")
def q_latest_snapshot_month(spark, sf_dir):
    """D29"""
    return pn.latest_snapshot(panel(spark, sf_dir, "month"), "period_end")


@register("usage_drop_quarter")
def q_usage_drop_quarter(spark, sf_dir):
    """Account-quarters whose usage fell below the own 4-quarter mean"""
    p = panel(spark, sf_dir, "quarter")
    return p.where(F.col("usage_drop_flag") == 1).select(
        "account_id", "quarter", "usage_count", "usage_count_roll4_mean", "usage_count_qoq_delta",
        "usage_count_vs_roll4_mean")


@register("label_availability")
def q_label_availability(spark, sf_dir):
    """D26-D28 per quarter: rows, availability and label sums after masking"""
    p = panel(spark, sf_dir, "quarter")
    return p.groupBy("quarter").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and("label_available_q1").alias("label_available_q1"),
        F.bool_and("label_available_q2").alias("label_available_q2"),
        F.count("churn_label_q1_rolling").alias("n_label_q1"),
        F.sum("churn_label_q1_rolling").cast("long").alias("sum_label_q1"),
        F.count("churn_label_q2_rolling").alias("n_label_q2"),
        F.sum("churn_label_q2_rolling").cast("long").alias("sum_label_q2"))


# ------------------------------------------------------------- QoQ, flags, features (E, F, G)

from churnlens.operators import flags as fl  # noqa: E402
from churnlens.operators import quality as qa  # noqa: E402
from churnlens.operators import qoq as qq  # noqa: E402
from churnlens.plans import jobs  # noqa: E402
from churnlens.plans.jobs import LABEL, labelled_features, metrics_row, processed_panel_for  # noqa: E402

QOQ_BASE = ["usage_count", "usage_hours", "active_days", "errors", "features_used",
            "tickets_opened", "escalations", "seats", "mrr_amount", "arr_amount"]
QOQ_COLS = [c + "_qoq_delta" for c in QOQ_BASE]


@register("qoq_processed")
def q_qoq_processed(spark, sf_dir):
    """Clipped, z and drop flag per QoQ delta"""
    p = processed_panel_for(spark, sf_dir, columns=["account_id", "quarter"])
    cols = []
    for c in QOQ_COLS:
        cols += [c, f"{c}_clipped", f"{c}_z", f"{c}_drop_flag"]
    return p.select("account_id", "quarter", *cols)


@register("qoq_summary")
def q_qoq_summary(spark, sf_dir):
    """E6"""
    from churnlens.plans.inputs import panel as build
    p = build(spark, sf_dir, "quarter", materialise=True)
    cols = qq.qoq_columns(p)
    return qq.qoq_summary(spark, qq.qoq_statistics(p, cols), cols)


@register("missing_flags")
def q_missing_flags(spark, sf_dir):
    """F1/F2"""
    p = processed_panel_for(spark, sf_dir, columns=["account_id", "quarter"])
    return p.select("account_id", "quarter", "satisfaction_missing_flag", "contract_missing_flag")


@register("contract_flags")
def q_contract_flags(spark, sf_dir):
    """F5-F7"""
    p = processed_panel_for(spark, sf_dir, columns=["account_id", "quarter"])
    return p.select("account_id", "quarter", "subscription_id_asof_qend", "effective_end_date",
                    "contract_end_observed_flag", "contract_end_inferred_flag")


FLAG_COLS = ["satisfaction_missing_flag", "contract_missing_flag",
             "contract_end_observed_flag", "contract_end_inferred_flag"]


@register("flag_distribution")
def q_flag_distribution(spark, sf_dir):
    """F3"""
    return fl.flag_distribution(processed_panel_for(spark, sf_dir, columns=[]), FLAG_COLS)


@register("contract_sanity")
def q_contract_sanity(spark, sf_dir):
    """F8"""
    return fl.contract_sanity(processed_panel_for(spark, sf_dir, columns=[]))


@register("label_backfill")
def q_label_backfill(spark, sf_dir):
    """Labels rebuilt from the masked event flags, then cleaned"""
    p = processed_panel_for(spark, sf_dir, columns=["account_id", "quarter"]).drop("churn_label_q1_rolling", "churn_label_q2_rolling")
    p = fl.clean_label_binary(fl.ensure_label(fl.backfill_labels(p)), "churn_label_q1_rolling")
    return p.select("account_id", "quarter", F.col("churn_label_q1_rolling").cast("int").alias("churn_label_q1_rolling"),
                    "churn_label_q2_rolling")


def feature_frame(spark, sf_dir, observed=False):
    """The feature table; ``observed``: labels only as far as their sources are observed."""
    return labelled_features(processed_panel_for(spark, sf_dir, observed=observed, columns=jobs.FEATURE_SOURCES))


@register("feature_set")
def q_feature_set(spark, sf_dir):
    """G1-G9"""
    return feature_frame(spark, sf_dir)


# ------------------------------------------------------------- panel quality (M)

@register("panel_shape")
def q_panel_shape(spark, sf_dir):
    """M1"""
    return qa.panel_shape(panel(spark, sf_dir, "quarter"))


@register("label_rate")
def q_label_rate(spark, sf_dir):
    """M2"""
    return qa.label_rate(panel(spark, sf_dir, "quarter"))


@register("label_rate_by_quarter")
def q_label_rate_by_quarter(spark, sf_dir):
    """M3"""
    return qa.label_rate_by_quarter(panel(spark, sf_dir, "quarter"))


@register("missing_rates")
def q_missing_rates(spark, sf_dir):
    """M4"""
    return qa.missing_rates(panel(spark, sf_dir, "quarter"))


@register("duplicate_keys")
def q_duplicate_keys(spark, sf_dir):
    """M5"""
    return qa.duplicate_keys(panel(spark, sf_dir, "quarter"))


# ------------------------------------------------------------- evaluation and risk output (H, I, A9)

from churnlens.operators import metrics as mt  # noqa: E402
from churnlens.operators import model as md  # noqa: E402
from churnlens.operators import risk as rk  # noqa: E402

def validation_scored(spark, sf_dir, spec=None, observed=False):
    """Validation rows (last two labelled quarters) scored by ``spec``."""
    spec = spec or md.fixed_scorer()
    s = mt.time_split(feature_frame(spark, sf_dir, observed), LABEL)
    v = s.where(F.col("split") == "valid")
    return v.select("account_id", "quarter", F.col(LABEL).cast("int").alias("label"), spec.probability().alias("p"))


@register("time_split")
def q_time_split(spark, sf_dir):
    """H1/H2"""
    s = mt.time_split(feature_frame(spark, sf_dir), LABEL)
    return s.groupBy("quarter", "split").agg(F.count(F.lit(1)).alias("n_rows"),
                                             F.sum(F.col(LABEL).cast("long")).alias("n_pos"))


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    """H12 (fixed scorer)"""
    return mt.roc_auc(validation_scored(spark, sf_dir))


@register("threshold_metrics")
def q_threshold_metrics(spark, sf_dir):
    """H13 (fixed scorer)"""
    return mt.threshold_metrics(validation_scored(spark, sf_dir))


@register("rank_metrics")
def q_rank_metrics(spark, sf_dir):
    """H14/H15 (fixed scorer; ties broken on account_id, quarter)"""
    return mt.rank_metrics(validation_scored(spark, sf_dir), tie_cols=["account_id", "quarter"])


@register("class_weights")
def q_class_weights(spark, sf_dir):
    """H9: given weights and 'balanced' on the training rows"""
    tr = mt.time_split(feature_frame(spark, sf_dir), LABEL).where(F.col("split") == "train")
    given = md.class_weight_table(tr, LABEL, md.parse_class_weight(md.DEFAULT_PARAMS["class_weight"]))
    bal = md.class_weight_table(tr, LABEL, "balanced")
    return given.withColumn("scheme", F.lit("given")).unionByName(bal.withColumn("scheme", F.lit("balanced")))


@register("validation_report")
def q_validation_report(spark, sf_dir):
    """H20"""
    return mt.validation_report(mt.time_split(feature_frame(spark, sf_dir), LABEL), LABEL)


@register("latest_risk")
def q_latest_risk(spark, sf_dir):
    """I1-I11 (fixed scorer)"""
    return rk.latest_risk_output(feature_frame(spark, sf_dir), md.fixed_scorer())


@register("demo_output")
def q_demo_output(spark, sf_dir):
    """I12"""
    return rk.demo_output(rk.latest_risk_output(feature_frame(spark, sf_dir), md.fixed_scorer()))


# The columns of an example upload, features and context.
EXAMPLE_FEATURES = ["usage_count_qoq_delta_z", "tickets_opened_qoq_delta_z", "usage_drop_flag",
                    "days_to_contract_end_capped", "arr_amount_qoq_delta_z", "seats_qoq_delta_z", "seats", "tenure",
                    "avg_satisfaction", "satisfaction_missing_flag", "contract_missing_flag",
                    "tenure_x_usage_drop_flag", "plan_tier"]
EXAMPLE_EXTRA = ["plan_tier", "company_size", "seats", "mrr_amount", "industry"]


@register("example_upload")
def q_example_upload(spark, sf_dir):
    """Latest rows per account, available feature + context columns (deduplicated)"""
    from churnlens.functions.columns import keep_present
    columns = ["account_id"] + EXAMPLE_FEATURES + EXAMPLE_EXTRA
    latest = rk.latest_rows(processed_panel_for(spark, sf_dir, columns=[*columns, "quarter_end"]))
    return keep_present(latest, columns)


# ------------------------------------------------------------- uploads, explanations, report (A3, B, J, K, L)

import datetime as _dt  # noqa: E402

from pyspark.sql import Window as _W  # noqa: E402

from churnlens.operators import explain as ex  # noqa: E402
from churnlens.operators import report as rp  # noqa: E402
from churnlens.operators import upload as up  # noqa: E402
from churnlens.sources.aliases import apply_aliases  # noqa: E402
from churnlens.sources.adapter import raw_tables  # noqa: E402
from churnlens.session import stored  # noqa: E402

TODAY = _dt.date(2001, 6, 30)  # fixed "today" for the multi-table upload


def quarterly_fixture(spark, sf_dir):
    """Quarterly upload shape of the whole panel: the last quarter with any usage
    is the new upload, all others are history (contract ends stretch the panel
    past it, so the history reaches beyond the upload)."""
    p = panel(spark, sf_dir, "quarter")
    q = stored(p.select("account_id", F.col("quarter_start").alias("as_of_quarter"),
                 F.col("usage_count").alias("usage_count_total"), F.col("tickets_opened").alias("ticket_count"),
                 F.col("avg_satisfaction").alias("avg_csat"), F.col("escalations").alias("escalation_count"),
                 F.col("days_to_contract_end_asof_qend").alias("days_to_contract_end"),
                 "plan_tier", "seats", "arr_amount", "mrr_amount", "signup_date"), "quarterly")
    last = q.where(F.col("usage_count_total") > 0).agg(F.max("as_of_quarter").alias("q")).first()["q"]  # one row
    is_new = F.col("as_of_quarter") == F.lit(last)
    return q.where(~is_new), q.where(is_new)


def single_fixture(spark, sf_dir):
    """Single wide shape of the whole panel: each account-quarter and the one before."""
    p = panel(spark, sf_dir, "quarter")
    w = _W.partitionBy("account_id").orderBy("quarter_end")
    prev = {c: F.lag(c).over(w) for c in ("usage_count", "tickets_opened", "seats", "arr_amount")}
    return stored(p.select("account_id", "plan_tier", "signup_date", F.col("quarter_end").alias("as_of_date"),
                    F.col("usage_count").alias("usage_count_current"), prev["usage_count"].alias("usage_count_prev"),
                    F.col("tickets_opened").alias("tickets_opened_current"),
                    prev["tickets_opened"].alias("tickets_opened_prev"),
                    F.col("days_to_contract_end_asof_qend").alias("days_to_contract_end_current"),
                    F.col("seats").alias("seats_current"), prev["seats"].alias("seats_prev"),
                    F.col("arr_amount").alias("arr_current"), prev["arr_amount"].alias("arr_prev"),
                    F.col("avg_satisfaction").alias("avg_satisfaction_current")), "single")


@register("standardised_ingest")
def q_standardised_ingest(spark, sf_dir):
    """Odd upload headers resolved back to canonical names"""
    s = raw_tables(spark, sf_dir).subscriptions.select(
        F.col("subscription_id").alias("sub_id"), F.col("account_id").alias(" Customer_ID "),
        "start_date", F.col("end_date").alias("Contract_End"), F.col("plan_tier").alias("Plan"),
        F.col("seats").alias("Licensed_Seats"), F.col("arr_amount").alias("ARR"))
    c = apply_aliases(s)
    return c.select("subscription_id", "account_id", "start_date", "end_date", "plan_tier", "seats", "arr_amount")


@register("upload_single")
def q_upload_single(spark, sf_dir):
    """J1-J6"""
    return up.build_from_single(single_fixture(spark, sf_dir), TODAY)


@register("upload_multi")
def q_upload_multi(spark, sf_dir):
    """J7-J13 (today fixed)"""
    r = raw_tables(spark, sf_dir)
    return up.build_from_multi(r.accounts, r.subscriptions, r.feature_usage, r.support_tickets, TODAY)


@register("history_upsert")
def q_history_upsert(spark, sf_dir):
    """Append the new quarter, then a revised copy of it (last wins)"""
    columns = ["account_id", "as_of_quarter", "usage_count_total", "ticket_count"]
    hist, new = (df.select(*columns) for df in quarterly_fixture(spark, sf_dir))  # a kept row is one struct: nothing prunes it later
    revised = new.withColumn("ticket_count", F.col("ticket_count") + 1)
    h = up.renew_history(up.renew_history(hist, new), revised)
    return h.select(*columns)


@register("history_medians")
def q_history_medians(spark, sf_dir):
    """J17"""
    hist, _ = quarterly_fixture(spark, sf_dir)
    return up.history_medians(up.dedup_history(up.dealt_history(hist)))


def quarterly_features(spark, sf_dir, with_history=True):
    hist, new = quarterly_fixture(spark, sf_dir)
    # the upload is read by several statistics passes: compute it once
    return stored(up.build_from_quarterly(hist if with_history else None, new, TODAY, strict_prior=True))


@register("upload_quarterly")
def q_upload_quarterly(spark, sf_dir):
    """J14-J19"""
    return quarterly_features(spark, sf_dir).drop("_row_order")


@register("pct_rank")
def q_pct_rank(spark, sf_dir):
    """K2: average percent rank of the upload's usage z-score"""
    f = quarterly_features(spark, sf_dir)
    return mt.pct_ranks(f.select("account_id", F.coalesce("usage_count_qoq_delta_z", F.lit(0.0)).alias("v")),
                        {"v": "pct_rank"}, "account_id")


EXPLAIN_OUT = ["account_id", "_usage_flag", "_usage_txt", "_support_flag", "_support_txt", "_sat_flag", "_sat_txt",
               "_comm_flag", "_comm_txt"]


def _explained(df):
    return df.select(*[F.col(c).alias(c.lstrip("_")) for c in EXPLAIN_OUT])


@register("explain_self")
def q_explain_self(spark, sf_dir):
    """K3-K7 against the account's own history"""
    return _explained(ex.explain_commercial(ex.explain_self(quarterly_features(spark, sf_dir))))


@register("explain_peers")
def q_explain_peers(spark, sf_dir):
    """K7-K10 against the other rows of the upload"""
    return _explained(ex.explain_commercial(ex.explain_peers(up.build_from_single(single_fixture(spark, sf_dir),
                                                                                 TODAY))))


def scored_quarterly(spark, sf_dir):
    return ex.score(quarterly_features(spark, sf_dir), md.fixed_scorer())


@register("scored")
def q_scored(spark, sf_dir):
    """K1, K11-K15 (fixed scorer, quarterly upload with history)"""
    return scored_quarterly(spark, sf_dir)


@register("coverage")
def q_coverage(spark, sf_dir):
    """L1"""
    r = raw_tables(spark, sf_dir)
    return rp.coverage(r.accounts, r.subscriptions, r.feature_usage, r.support_tickets)


@register("score_health")
def q_score_health(spark, sf_dir):
    """L2"""
    f = quarterly_features(spark, sf_dir)
    return rp.score_health(ex.score(f, md.fixed_scorer()), f)


@register("kpis")
def q_kpis(spark, sf_dir):
    """L3"""
    return rp.kpis(scored_quarterly(spark, sf_dir))


@register("tier_counts")
def q_tier_counts(spark, sf_dir):
    """L4"""
    return rp.tier_counts(scored_quarterly(spark, sf_dir))


@register("prob_histogram")
def q_prob_histogram(spark, sf_dir):
    """18 and 24 bins"""
    s = scored_quarterly(spark, sf_dir)
    return rp.prob_histogram(s, 18).unionByName(rp.prob_histogram(s, 24))


@register("top_risk")
def q_top_risk(spark, sf_dir):
    """L6 (top-k is the feature)"""
    return rp.top_risk(scored_quarterly(spark, sf_dir), 20)


@register("driver_counts")
def q_driver_counts(spark, sf_dir):
    """L8 (top-k is the feature)"""
    return rp.driver_counts(scored_quarterly(spark, sf_dir), 12)


@register("risk_view")
def q_risk_view(spark, sf_dir):
    """The filtered table with its place in display order"""
    return rp.ranked_view(scored_quarterly(spark, sf_dir))


@register("risk_view_head")
def q_risk_view_head(spark, sf_dir):
    """The first 40 rows in display order (the limit is the feature)"""
    return rp.view_head(rp.ranked_view(scored_quarterly(spark, sf_dir)))


@register("upload_duplicate_keys")
def q_upload_duplicate_keys(spark, sf_dir):
    """M5 on data that has duplicates: the history with the new quarter and its revision, before keep-last"""
    hist, new = quarterly_fixture(spark, sf_dir)
    every = hist.unionByName(new).unionByName(new.withColumn("ticket_count", F.col("ticket_count") + 1))
    return qa.duplicate_keys(every.withColumnRenamed("as_of_quarter", "quarter"))


# ------------------------------------------------------------- observed labels (H2, H12-H15, H19, H20 on real folds)

from churnlens.operators import fit as ff  # noqa: E402
from churnlens.operators import horizon as hz  # noqa: E402


@register("source_horizons")
def q_source_horizons(spark, sf_dir):
    """How far each source has been observed (contract ends are plans)"""
    return hz.source_horizons(load_facts(spark, sf_dir).sources()).drop("observed_from_idx", "observed_until_idx")


@register("observed_label_availability")
def q_observed_label_availability(spark, sf_dir):
    """D27/D28 with the sources' horizons: rows, availability and label sums per quarter"""
    p = load_facts(spark, sf_dir).panel("quarter", observed=True)
    return p.groupBy("quarter").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and("label_available_q1").alias("label_available_q1"),
        F.bool_and("label_available_q2").alias("label_available_q2"),
        F.count("churn_label_q1_rolling").alias("n_label_q1"),
        F.sum("churn_label_q1_rolling").cast("long").alias("sum_label_q1"),
        F.count("churn_label_q2_rolling").alias("n_label_q2"),
        F.sum("churn_label_q2_rolling").cast("long").alias("sum_label_q2"))


def train_split(spark, sf_dir):
    """Labelled rows with their split, written once for the passes of the fit."""
    return stored(mt.time_split(feature_frame(spark, sf_dir, observed=True), LABEL))


@register("observed_time_split")
def q_observed_time_split(spark, sf_dir):
    """H1/H2 on observed labels"""
    s = mt.time_split(feature_frame(spark, sf_dir, observed=True), LABEL)
    return s.groupBy("quarter", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(LABEL).cast("long")).alias("n_pos"))


@register("observed_validation_report")
def q_observed_validation_report(spark, sf_dir):
    """H20 on observed labels"""
    return mt.validation_report(mt.time_split(feature_frame(spark, sf_dir, observed=True), LABEL), LABEL)


@register("observed_metrics")
def q_observed_metrics(spark, sf_dir):
    """H12-H15 on observed labels (fixed scorer)"""
    return metrics_row(validation_scored(spark, sf_dir, observed=True))


@register("observed_threshold_curve")
def q_observed_threshold_curve(spark, sf_dir):
    """H13 at several thresholds on observed labels (fixed scorer)"""
    return mt.threshold_curve(validation_scored(spark, sf_dir, observed=True), [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5])


@register("observed_folds")
def q_observed_folds(spark, sf_dir):
    """H19's folds on observed labels (fixed scorer)"""
    return md.timeseries_folds(train_split(spark, sf_dir), LABEL, 5, spec=md.fixed_scorer())


# ------------------------------------------------------------- fitted model

@register("preprocessor_table")
def q_preprocessor_table(spark, sf_dir):
    """H3-H7: what the training quarters say to impute, subtract and divide by"""
    train = train_split(spark, sf_dir).where(F.col("split") == "train")
    return ff.preprocessor_table(spark, ff.preprocessors(train, {"all": F.lit(True)})["all"])


@register("trained_scores")
def q_trained_scores(spark, sf_dir):
    """The validation quarters scored by the model of the training quarters"""
    s = train_split(spark, sf_dir)
    return jobs.validation_scores(s, jobs.fit_model(s)).withColumn("p", F.round("p", 5))


@register("fit_optimality")
def q_fit_optimality(spark, sf_dir):
    """H8: subgradient residual of every coefficient, by an aggregate of its own"""
    s = train_split(spark, sf_dir)
    t = ff.optimality(s.where(F.col("split") == "train"), jobs.fit_model(s), LABEL)
    return t.select("term", F.round("coefficient", 6).alias("coefficient"), F.round("residual", 6).alias("residual"), "optimal")


@register("trained_metrics")
def q_trained_metrics(spark, sf_dir):
    """The model metrics row for the fitted model"""
    s = train_split(spark, sf_dir)
    return metrics_row(jobs.validation_scores(s, jobs.fit_model(s))).crossJoin(jobs.settings_row(spark))


@register("coefficient_table")
def q_coefficient_table(spark, sf_dir):
    """Coefficients, odds ratios, direction and base feature, strongest first"""
    s = train_split(spark, sf_dir)
    return jobs.coefficient_report(spark, jobs.fit_model(s))


@register("cv_folds")
def q_cv_folds(spark, sf_dir):
    """Expanding-window folds over the last observed quarters, fitted side by side"""
    return md.timeseries_folds(train_split(spark, sf_dir), LABEL, 5)


@register("cv_summary")
def q_cv_summary(spark, sf_dir):
    """The folds in one row"""
    return md.cv_summary(md.timeseries_folds(train_split(spark, sf_dir), LABEL, 5))


@register("driver_strength")
def q_driver_strength(spark, sf_dir):
    """Global driver strength -- absolute coefficients summed per base feature"""
    s = train_split(spark, sf_dir)
    t = jobs.fit_model(s).coefficient_table(spark)
    return t.groupBy("base_feature").agg(F.sum("abs_coefficient").alias("abs_coefficient"))


# ------------------------------------------------------------- jobs (A1, A3, A7, A8): write, read in another run, score

from churnlens.session import scratch_path  # noqa: E402
from churnlens.sources import raw  # noqa: E402


@register("stored_model_risk")
def q_stored_model_risk(spark, sf_dir):
    """Fit, store, load, and rank the latest quarter by the loaded model"""
    table = stored(feature_frame(spark, sf_dir, observed=True))
    path = scratch_path(spark, "model")
    md.save_spec(spark, jobs.fit_model(stored(mt.time_split(table, LABEL))), path)
    return rk.latest_risk_output(table, jobs.load_model(spark, [path + "-preferred", path]))


def score_written(spark, mode, tables, **options):
    """Write an upload as CSV and the fixed scorer as a stored model, then run the score job on the paths."""
    base = scratch_path(spark, f"upload-{mode}")
    for name, df in tables.items():
        jobs.write_table(df, f"{base}/{name}", fmt="csv", compression="gzip")
    md.save_spec(spark, md.fixed_scorer(), f"{base}/model")
    return jobs.score_job(spark, mode, {n: f"{base}/{n}" for n in tables}, [f"{base}/model"], TODAY, **options)


@register("score_job_single")
def q_score_job_single(spark, sf_dir):
    """A8, J6, K: the score job in single mode, explained against peers"""
    return score_written(spark, "single", {"single": single_fixture(spark, sf_dir)})["scored"]


@register("score_job_multi")
def q_score_job_multi(spark, sf_dir):
    """A8, J13, K: the score job in multi-table mode"""
    r = raw_tables(spark, sf_dir)
    return score_written(spark, "multi", {"accounts": r.accounts, "subscriptions": r.subscriptions, "usage": r.feature_usage,
                                          "tickets": r.support_tickets})["scored"]


@register("score_job_quarterly")
def q_score_job_quarterly(spark, sf_dir):
    """A8, J19, K: the score job in quarterly mode, explained against the own history"""
    hist, new = quarterly_fixture(spark, sf_dir)
    return score_written(spark, "quarterly", {"history": hist, "new": new}, strict_prior=True)["scored"]


def damaged_csv(spark, sf_dir):
    """Subscriptions as a CSV with odd headers, unreadable dates and numbers and missing ids."""
    s = raw_tables(spark, sf_dir).subscriptions
    k = F.col("subscription_id").cast("long")
    text = s.select(
        F.when(k % 17 != 0, F.col("account_id")).alias(" account_id "), F.when(k % 19 != 0, F.col("subscription_id")).alias("subscription_id"),
        F.when(k % 11 == 0, F.lit("2001-13-45")).otherwise(F.col("start_date").cast("string")).alias("start_date"),
        F.when(k % 13 == 0, F.lit("soon")).otherwise(F.col("end_date").cast("string")).alias("end_date"), "plan_tier",
        F.when(k % 7 == 0, F.lit("12 seats")).otherwise(F.col("seats").cast("string")).alias("seats"),
        F.when(k % 23 == 0, F.lit("n/a")).otherwise(F.col("arr_amount").cast("string")).alias("arr_amount"),
        F.when(k % 29 == 0, F.lit("maybe")).otherwise(F.col("auto_renew_flag").cast("string")).alias("auto_renew_flag"), F.lit("x").alias("unknown"))
    path = scratch_path(spark, "raw-csv")
    jobs.write_table(text, path, fmt="csv")
    return raw.Ingest(spark.read.option("header", True).csv(path), "subscriptions")


@register("ingest_rows")
def q_ingest_rows(spark, sf_dir):
    """A1, A3: a CSV read back with declared types"""
    return damaged_csv(spark, sf_dir).rows.select("subscription_id", "account_id", "start_date", "end_date", "plan_tier", "seats",
                                                  "arr_amount", "auto_renew_flag")


@register("ingest_rejects")
def q_ingest_rejects(spark, sf_dir):
    """A3: unreadable values by column and rows without an id"""
    return damaged_csv(spark, sf_dir).rejects


@register("staged_latest_snapshot")
def q_staged_latest_snapshot(spark, sf_dir):
    """The panel stored as a stage; the snapshot's account window reads it without an exchange"""
    path = scratch_path(spark, "stage")
    stage = jobs.Stage(f"quarter_panel_{path[-32:]}", path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stage.write(panel(spark, sf_dir, "quarter"))
    return pn.latest_snapshot(stage.open(spark), "quarter_end")
