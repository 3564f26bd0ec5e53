"""Latest-quarter churn-risk output (I1-I12) as native column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.periods import label_to_index, period_index, period_label
from churnlens.operators.features import PRIMARY_PREDICTORS
from churnlens.operators.model import LinearSpec

# Driver category per primary predictor, action per category,
# risk family per feature, tier cut-offs and the horizon-window cut-off.
DRIVER_CATEGORY = {
    "usage_count_qoq_delta_z": "Usage decline",
    "tickets_opened_qoq_delta_z": "Support pressure",
    "arr_amount_qoq_delta_z": "Commercial contraction",
    "days_to_contract_end_capped": "Contract risk",
}
DRIVER_ACTION = {
    "Usage decline": "Usage re-engagement / training",
    "Support pressure": "Proactive support / escalation review",
    "Contract risk": "Renewal outreach",
    "Commercial contraction": "Commercial check-in",
}
DEFAULT_ACTION = "General retention check-in"
RISK_TYPE_MAP = {
    "Usage Risk": ["usage_count_qoq_delta_z"],
    "Support Risk": ["tickets_opened_qoq_delta_z"],
    "Commercial Risk": ["arr_amount_qoq_delta_z"],
}
HIGH, MEDIUM = 0.50, 0.35
WINDOW_CUTOFF = 0.35
WINDOWS = ["0-90 days", "3-6 months", "6-12 months", "> 365 days"]

RISK_OUTPUT_COLUMNS = [
    "account_id", "churn_probability_q1", "churn_prob_q1", "churn_prob_q2", "churn_prob_q3", "churn_prob_q4",
    "churn_date_window", "churn_prob_within_2q", "churn_prob_within_4q", "risk_score", "risk_tier",
    "risk_type", "predicted_churn_quarter", "top_drivers", "recommended_action",
]


def latest_rows(df: DataFrame, end_col: str = "quarter_end") -> DataFrame:
    """Rows at each account's latest ``end_col`` (ties kept)."""
    w = Window.partitionBy("account_id")
    return df.withColumn("_mx", F.max(end_col).over(w)).where(F.col(end_col) == F.col("_mx")).drop("_mx")


def risk_tier(p, high: float = HIGH, medium: float = MEDIUM):
    """I3 / K1 tier cut-offs."""
    return F.when(p >= high, "High").when(p >= medium, "Medium").otherwise("Low")


def risk_score(p):
    """Round-half-even of p * 100."""
    return F.bround(p * 100, 0).cast("int")


def _map(d: dict):
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def score_and_explain(df: DataFrame, spec: LinearSpec, high: float = HIGH, medium: float = MEDIUM) -> DataFrame:
    """I2-I10 on any frame holding the model features."""
    p = spec.probability()
    out = df.withColumn("churn_probability_q1", p)
    pc = F.col("churn_probability_q1")
    horizons = {k: F.lit(1.0) - F.pow(F.lit(1.0) - pc, F.lit(float(k))) for k in (1, 2, 3, 4)}
    window = F.lit("N/A")
    for k in (4, 3, 2, 1):
        window = F.when(horizons[k] >= WINDOW_CUTOFF, F.lit(WINDOWS[k - 1])).otherwise(window)
    out = out.select("*",
                     pc.alias("churn_prob_q1"), horizons[2].alias("churn_prob_q2"),
                     horizons[3].alias("churn_prob_q3"), horizons[4].alias("churn_prob_q4"),
                     horizons[2].alias("churn_prob_within_2q"), horizons[4].alias("churn_prob_within_4q"),
                     risk_score(pc).alias("risk_score"), risk_tier(pc, high, medium).alias("risk_tier"),
                     window.alias("churn_date_window"))
    # Contributions of the primary predictors, summed per driver category
    by_cat: dict[str, object] = {}
    order: list[str] = []
    for t in spec.terms:
        if t.base in PRIMARY_PREDICTORS:
            cat = DRIVER_CATEGORY.get(t.base, "Other")
            if cat not in by_cat:
                order.append(cat)
                by_cat[cat] = F.lit(0.0)
            by_cat[cat] = by_cat[cat] + spec.contribution(t)
    ranked = F.array_sort(F.array(*[F.struct((-by_cat[c]).alias("neg"), F.lit(i).alias("pos"), F.lit(c).alias("name"))
                                    for i, c in enumerate(order)]))
    names = F.transform(F.slice(ranked, 1, 3), lambda s: s["name"])
    actions = F.transform(F.slice(names, 1, 2), lambda n: F.coalesce(_map(DRIVER_ACTION)[n], F.lit(DEFAULT_ACTION)))
    out = out.withColumn("top_drivers", F.array_join(names, ", ")) \
        .withColumn("recommended_action", F.array_join(actions, " / "))
    # Family with the largest absolute contribution (ties: map order)
    fam = {}
    for rt, feats in RISK_TYPE_MAP.items():
        s = F.lit(0.0)
        for t in spec.terms:
            if t.base in feats:
                s = s + F.abs(spec.contribution(t))
        fam[rt] = s
    u, s_, c = fam["Usage Risk"], fam["Support Risk"], fam["Commercial Risk"]
    rtype = F.when((u >= s_) & (u >= c), "Usage Risk").when(s_ >= c, "Support Risk").otherwise("Commercial Risk")
    out = out.withColumn("risk_type", rtype)
    # Next quarter after the row's quarter (label, else quarter_end)
    if "quarter" in out.columns:
        idx = F.coalesce(label_to_index(F.col("quarter")), period_index(F.to_date("quarter_end")))
    else:
        idx = period_index(F.to_date("quarter_end"))
    return out.withColumn("predicted_churn_quarter", period_label(idx + 1))


def latest_risk_output(features: DataFrame, spec: LinearSpec) -> DataFrame:
    """The 15-column risk output for each account's latest quarter."""
    return score_and_explain(latest_rows(features), spec).select(*RISK_OUTPUT_COLUMNS)


def demo_output(risk: DataFrame) -> DataFrame:
    """The renamed 12-column demo subset."""
    return risk.select("account_id", "churn_probability_q1", "churn_prob_q1", "churn_prob_q2", "churn_prob_q3",
                       "churn_prob_q4", "churn_date_window", "risk_tier", "risk_type", "predicted_churn_quarter",
                       F.col("top_drivers").alias("key_risks"),
                       F.col("recommended_action").alias("recommended_actions"))
