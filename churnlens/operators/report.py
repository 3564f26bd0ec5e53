"""Report aggregates behind the scoring UI (L1-L10) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.explain import fmt
from churnlens.operators.ordered import sequence_within

TIERS = ["High", "Medium", "Low"]
# Tier sort order and badge text.
TIER_ORDER = {"High": 0, "Medium": 1, "Low": 2}
TIER_BADGE = {"High": "🔴 High", "Medium": "🟠 Medium", "Low": "🟢 Low"}
HEALTH_INPUTS = ["usage_count_qoq_delta_z", "tickets_opened_qoq_delta_z", "usage_drop_flag",
                 "days_to_contract_end_capped", "arr_amount_qoq_delta_z", "seats_qoq_delta_z", "seats",
                 "tenure", "avg_satisfaction"]


def coverage(accounts: DataFrame, subs: DataFrame, usage: DataFrame | None, tickets: DataFrame | None) -> DataFrame:
    """L1: row counts and coverage shares (NULL when the optional table is absent)."""
    a = accounts.agg(F.count(F.lit(1)).alias("accounts"), F.countDistinct("account_id").alias("_na"))
    s = subs.agg(F.count(F.lit(1)).alias("subscriptions"), F.countDistinct("subscription_id").alias("_ns"))
    out = a.crossJoin(s)
    if usage is not None and "subscription_id" in usage.columns:
        out = out.crossJoin(usage.agg(F.countDistinct("subscription_id").alias("_us")))
        out = out.withColumn("usage_coverage_subs", F.col("_us") / F.greatest(F.lit(1), F.col("_ns")))
    else:
        out = out.withColumn("usage_coverage_subs", F.lit(None).cast("double"))
    if tickets is not None and "account_id" in tickets.columns:
        out = out.crossJoin(tickets.agg(F.countDistinct("account_id").alias("_ta")))
        out = out.withColumn("ticket_coverage_accounts", F.col("_ta") / F.greatest(F.lit(1), F.col("_na")))
    else:
        out = out.withColumn("ticket_coverage_accounts", F.lit(None).cast("double"))
    missing = [n for n, t in (("usage", usage), ("tickets", tickets)) if t is None]
    return out.select("accounts", "subscriptions", "usage_coverage_subs", "ticket_coverage_accounts",
                      F.lit(",".join(missing)).alias("missing_optional"))


def _spread(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, unique_values, std_dev).  Values are unpivoted and combined per
    (column, value) on the map side, so no row is expanded once per distinct
    count and a dominant value leaves a task once."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    unique = cells.groupBy("column", "v").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("v").alias("unique_values"))
    spread = cells.groupBy("column").agg(F.stddev_samp("v").alias("std_dev"))
    return unique.join(F.broadcast(spread), "column")  # a row per column


def score_health(scored: DataFrame, feats: DataFrame | None = None) -> DataFrame:
    """L2: distinct count and sample std per input (and the probability);
    ``degenerate`` when the probability has <= 3 values or std < 1e-4."""
    rows = _spread(scored, ["risk_probability"])
    if feats is not None:
        rows = rows.unionByName(_spread(feats, [c for c in HEALTH_INPUTS if c in feats.columns]))
    p = rows.where(F.col("column") == "risk_probability").select(
        ((F.col("unique_values") <= 3) | (F.coalesce(F.col("std_dev"), F.lit(0.0)) < 1e-4)).alias("degenerate"))
    return rows.crossJoin(p)


def kpis(scored: DataFrame) -> DataFrame:
    """L3: rows, mean probability, High and Medium counts."""
    return scored.agg(F.count(F.lit(1)).alias("rows_scored"), F.avg("risk_probability").alias("avg_probability"),
                      F.count_if(F.col("risk_tier") == "High").alias("high_risk"),
                      F.count_if(F.col("risk_tier") == "Medium").alias("medium_risk"))


def tier_counts(scored: DataFrame) -> DataFrame:
    """L4: counts in tier order, absent tiers 0."""
    tiers = scored.sparkSession.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "risk_tier string, tier_order int")
    c = scored.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(tiers).join(c, "risk_tier", "left").select(
        "risk_tier", "tier_order", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def prob_histogram(scored: DataFrame, bins: int) -> DataFrame:
    """Counts per bin on [0, 1] (last bin closed), empty bins included."""
    b = F.least(F.floor(F.col("risk_probability") * bins), F.lit(bins - 1)).cast("int")
    c = scored.where(F.col("risk_probability").between(0.0, 1.0)).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    all_bins = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return F.broadcast(all_bins).join(c, "bin", "left").select(
        F.lit(bins).alias("bins"), "bin", (F.col("bin") / F.lit(float(bins))).alias("lo"),
        ((F.col("bin") + 1) / F.lit(float(bins))).alias("hi"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def _tier_order_col():
    m = F.create_map(*[x for k, v in TIER_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col("risk_tier")], F.lit(9))


def display_columns(scored: DataFrame) -> DataFrame:
    """Percent text, first driver token, recommendation, tier order, badge."""
    badge = F.create_map(*[x for k, v in TIER_BADGE.items() for x in (F.lit(k), F.lit(v))])
    first = F.trim(F.element_at(F.filter(F.split(F.coalesce(F.col("drivers"), F.lit("")), r"\|"),
                                         lambda t: F.trim(t) != ""), 1))
    return scored.select("*",
                         F.concat(fmt(F.col("risk_probability") * 100, 1), F.lit("%"))
                         .alias("risk_probability_pct"),
                         F.coalesce(first, F.lit("")).alias("primary_driver"),
                         F.col("recommendation").cast("string").alias("primary_reco"),
                         _tier_order_col().alias("_tier_order"),
                         F.coalesce(badge[F.col("risk_tier")], F.lit(TIER_BADGE["Low"])).alias("risk_badge"))


def top_risk(scored: DataFrame, k: int = 20) -> DataFrame:
    """Top-k by tier order, then probability desc (tie: account_id)."""
    d = display_columns(scored)
    return d.orderBy("_tier_order", F.col("risk_probability").desc(), "account_id").limit(k).select(
        "account_id", "risk_badge", "risk_probability_pct", "risk_type", "primary_driver", "primary_reco")


def risk_view(scored: DataFrame, tiers=("High", "Medium"), min_prob: float = 0.0, risk_types=None) -> DataFrame:
    """B13 + L7: filtered table in display order (tier, probability desc)."""
    d = display_columns(scored).where(F.col("risk_tier").isin(*tiers) & (F.col("risk_probability") >= min_prob))
    if risk_types is not None:
        d = d.where(F.col("risk_type").isin(*risk_types))
    return d.select("account_id", "risk_score", "risk_probability_pct", "risk_badge", "risk_type",
                    "primary_driver", "primary_reco", "_tier_order", "risk_probability")


def ranked_view(scored: DataFrame, **filters) -> DataFrame:
    """The filtered table with its place in display order (tier, probability
    desc; ties by account) as ``position``, numbered without a global sort."""
    return sequence_within(risk_view(scored, **filters), [], ["_tier_order", F.col("risk_probability").desc(), "account_id"], seq_col="position")


def view_head(ranked: DataFrame, k: int = 40) -> DataFrame:
    """The first ``k`` rows in display order."""
    return ranked.where(F.col("position") <= k)


def driver_counts(scored: DataFrame, k: int = 12) -> DataFrame:
    """Driver phrases of High + Medium rows, split on '|', trimmed, counted; top k."""
    toks = scored.where(F.col("risk_tier").isin("High", "Medium") & F.col("drivers").isNotNull()) \
        .select(F.explode(F.split("drivers", r"\|")).alias("t")).select(F.trim("t").alias("driver")) \
        .where(F.col("driver") != "")
    return toks.groupBy("driver").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), "driver").limit(k)


def lookup(scored: DataFrame, account_id: str) -> DataFrame:
    """One account's rows."""
    return scored.where(F.col("account_id") == F.lit(str(account_id)))


DISPLAY_COLS = ["risk_probability_pct", "primary_driver", "primary_reco", "_tier_order", "risk_badge"]


def export_scored(scored: DataFrame, path: str) -> None:
    """A10: the scored table without display-only columns, as CSV with a header."""
    scored.drop(*[c for c in DISPLAY_COLS if c in scored.columns]) \
        .write.mode("overwrite").option("header", True).csv(path)
