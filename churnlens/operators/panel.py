"""Account x period panels (month and quarter) with own-history features and
right-censoring-aware churn labels.

Plan shape (one pass over each fact, no per-period rescans):

* usage is dealt by subscription once and collapsed there to (subscription, period,
  feature), with its days as bits of two longs, where the subscription map meets it;
  tickets, churn events and contract ends are pre-aggregated with map-side partial
  aggregation to (account_id, p_idx) -- a hot account is spread over its periods;
* the as-of subscription pick is an exact interval join: the periods at whose end a
  subscription is in force are one span, spans are dealt by account, exploded there, and
  the greatest key per (account, period) meets the subscription it stands for;
* every input is dealt by ``account_id`` once, with as few rows as it has by then; accounts
  are dealt alike, build their periods there and take each input in by a merge, whose
  order and partitioning the own-history windows reuse (no row of the panel is shuffled).
  Rows per account are bounded by the number of periods, so the window never sees a
  skewed key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.columns import flag
from churnlens.functions.periods import period_end, period_index, period_label, period_start, within_period_cut
from churnlens.operators.calendar import account_spine, bounds_literals, date_range, period_bounds
from churnlens.operators.horizon import Horizons

DURATION_CANDIDATES = ["usage_duration_secs", "usage_duration_seconds", "usage_duration_sec"]
BASE_DELTA_COLS = ["usage_count", "usage_hours", "active_days", "errors", "features_used",
                   "tickets_opened", "escalations", "seats", "mrr_amount", "arr_amount"]
DAY_BITS = 60  # days of a period per long; a quarter has 92 at most
ROLL_COLS = ["usage_count", "usage_hours", "tickets_opened", "errors", "features_used", "mrr_amount", "seats"]
COMMERCIAL_COLS = ["subscription_id", "plan_tier", "seats", "mrr_amount", "arr_amount",
                   "billing_frequency", "end_date_inferred"]


def names(grain: str) -> dict:
    """Output column names per grain (month panel uses ``period`` names)."""
    if grain == "quarter":
        return dict(label="quarter", start="quarter_start", end="quarter_end",
                    sub_id="subscription_id_asof_qend", active="active_sub_at_qend",
                    days="days_to_contract_end_asof_qend",
                    c_cnt="account_churn_event_count_in_quarter", c_in="account_churn_event_in_quarter",
                    c_cnt_next="account_churn_event_count_in_next_quarter",
                    c_next="account_churn_event_in_next_quarter",
                    c_next2="account_churn_event_in_second_next_quarter",
                    e_cnt="subscription_ends_in_quarter", e_in="subscription_end_in_quarter",
                    e_cnt_next="subscription_ends_in_next_quarter", e_next="subscription_end_in_next_quarter",
                    delta="_qoq_delta", window=4)
    if grain == "month":
        return dict(label="period", start="period_start", end="period_end",
                    sub_id="subscription_id_asof_period_end", active="active_sub_at_period_end",
                    days="days_to_contract_end_asof_period_end",
                    c_cnt="account_churn_event_count_in_period", c_in="account_churn_event_in_period",
                    c_cnt_next="account_churn_event_count_in_next_period",
                    c_next="account_churn_event_in_next_period", c_next2=None,
                    e_cnt="subscription_ends_in_period", e_in="subscription_end_in_period",
                    e_cnt_next="subscription_ends_in_next_period", e_next="subscription_end_in_next_period",
                    delta="_mom_delta", window=3)
    raise ValueError(f"unknown grain {grain!r}")


# ------------------------------------------------------------------ pieces

def usage_rows(usage: DataFrame, sub_fact: DataFrame | None = None, grain: str = "quarter") -> DataFrame:
    """D5 before its last grouping: per (account_id, p_idx[, feature_name]) and
    subscription the summed measures and the days in use, as bits of two longs.
    Accepts a usage fact (with account_id) or raw usage plus the subscription
    map; rows are collapsed to (subscription, period, feature) *before* they
    meet the map, so the join sees no single days.  Raw rows are dealt by
    subscription, which serves the collapse and the join: they are shuffled once."""
    sums = [c for c in ("usage_count", "error_count", *DURATION_CANDIDATES) if c in usage.columns]
    owner = "account_id" if "account_id" in usage.columns else "subscription_id"
    if owner == "subscription_id" and sub_fact is None:
        raise ValueError("raw usage needs the subscription fact to find account_id")
    p = period_index("usage_date", grain)
    day = F.datediff("usage_date", period_start(p, grain))
    bit = lambda lo: F.when((day >= lo) & (day < lo + DAY_BITS), F.call_function(
        "shiftleft", F.lit(1).cast("long"), (day - lo).cast("int"))).otherwise(F.lit(0).cast("long"))
    keys = [owner, "p_idx"] + (["feature_name"] if "feature_name" in usage.columns else [])
    u = usage.where(F.col(owner).isNotNull() & F.col("usage_date").isNotNull())
    if owner == "subscription_id":
        u = u.repartition(owner)
    pre = u.select("*", p.alias("p_idx"), bit(0).alias("_day0"), bit(DAY_BITS).alias("_day1")).groupBy(*keys).agg(
        F.bit_or("_day0").alias("_day0"), F.bit_or("_day1").alias("_day1"), *[F.sum(c).alias(c) for c in sums])
    if owner == "subscription_id":
        of = sub_fact.select("subscription_id", "account_id").repartition("subscription_id").distinct()
        pre = pre.join(of, "subscription_id").drop("subscription_id")
    return pre.where(F.col("account_id").isNotNull())


def usage_sums(rows: DataFrame) -> list[Column]:
    """How ``usage_rows`` of one group add up; the names stay."""
    kept = {"_day0", "_day1"}
    return [(F.bit_or(c) if c in kept else F.sum(c)).alias(c)
            for c in rows.columns if c in kept | {"usage_count", "error_count", *DURATION_CANDIDATES}]


def usage_measures(cols: list[str]) -> dict[str, Column]:
    """The measures of D5 from the added-up columns."""
    dur = next((c for c in DURATION_CANDIDATES if c in cols), None)
    out = {"active_days": (F.bit_count("_day0") + F.bit_count("_day1")).cast("long")}
    if "usage_count" in cols:
        out["usage_count"] = F.col("usage_count")
    if dur:
        out["usage_hours"] = F.col(dur) / 3600.0
    if "error_count" in cols:
        out["errors"] = F.col("error_count")
    return out


def usage_in_account(rows: DataFrame) -> DataFrame:
    """D5 of ``usage_rows``: one hash partitioning by account serves the grouping
    by feature and the one without.  All sums are of fixed width, so both are
    hash aggregates, and the collapse gets a row per (account, period) instead of
    sorting a row per feature."""
    own = rows.repartition("account_id")
    counted = []
    if "feature_name" in rows.columns:
        own = own.groupBy("account_id", "p_idx", "feature_name").agg(*usage_sums(rows))
        counted = [F.count("feature_name").cast("long").alias("features_used")]
    g = own.groupBy("account_id", "p_idx").agg(*usage_sums(rows), *counted)
    return g.select("account_id", "p_idx", *[v.alias(c) for c, v in usage_measures(g.columns).items()],
                    *(["features_used"] if counted else []))


def usage_by_period(usage: DataFrame, sub_fact: DataFrame | None = None, grain: str = "quarter") -> DataFrame:
    """Per (account_id, p_idx): distinct usage days, usage count, hours,
    errors, distinct features.  Days are bits, so only the features need a
    distinct count, and no row is expanded."""
    rows = usage_rows(usage, sub_fact, grain)
    features = [F.countDistinct("feature_name").alias("features_used")] if "feature_name" in rows.columns else []
    g = rows.groupBy("account_id", "p_idx").agg(*usage_sums(rows), *features)
    return g.select("account_id", "p_idx", *[v.alias(c) for c, v in usage_measures(g.columns).items()],
                    *(["features_used"] if features else []))


def tickets_by_period(tickets: DataFrame, grain: str = "quarter", last_day_full: bool = False) -> DataFrame:
    """Tickets opened, escalations, mean satisfaction per (account, period).
    Tickets later than midnight on a period's last day are in no period unless
    ``last_day_full``."""
    t = tickets.where(F.col("account_id").isNotNull() & F.col("submitted_at").isNotNull()) \
        .where(within_period_cut("submitted_at", grain, last_day_full)) \
        .withColumn("p_idx", period_index(F.to_date("submitted_at"), grain))
    cnt = F.count("ticket_id") if "ticket_id" in t.columns else F.count("submitted_at")
    esc = F.sum(F.col("escalation_flag").cast("int")) if "escalation_flag" in t.columns else F.lit(0)
    sat = F.avg("satisfaction_score") if "satisfaction_score" in t.columns else F.lit(None).cast("double")
    return t.groupBy("account_id", "p_idx").agg(cnt.cast("long").alias("tickets_opened"),
                                                esc.cast("long").alias("escalations"),
                                                sat.cast("double").alias("avg_satisfaction"))


def _counted(events: DataFrame, idx: Column) -> DataFrame:
    """(account_id, ev_idx, n): events by account and period, dealt by account."""
    return events.groupBy("account_id", idx.alias("ev_idx")).agg(F.count(F.lit(1)).alias("n")).repartition("account_id")


def churn_by_period(churn: DataFrame, grain: str = "quarter") -> DataFrame:
    """Churn events in this, the next and the second-next period, keyed
    by the period that *sees* them (an event in p counts for p, p-1, p-2)."""
    c = _counted(churn.where(F.col("account_id").isNotNull() & F.col("churn_date").isNotNull()), period_index("churn_date", grain))
    shifts = [F.struct(F.lit(0).alias("s"), F.lit(1).alias("c0"), F.lit(0).alias("c1"), F.lit(0).alias("c2")),
              F.struct(F.lit(1).alias("s"), F.lit(0).alias("c0"), F.lit(1).alias("c1"), F.lit(0).alias("c2"))]
    if grain == "quarter":
        shifts.append(F.struct(F.lit(2).alias("s"), F.lit(0).alias("c0"), F.lit(0).alias("c1"), F.lit(1).alias("c2")))
    x = c.select("account_id", "ev_idx", "n", F.explode(F.array(*shifts)).alias("sh"))
    return x.groupBy("account_id", (F.col("ev_idx") - F.col("sh.s")).alias("p_idx")).agg(
        *[F.sum(F.col("n") * F.col(f"sh.{c}")).cast("long").alias(name)
          for c, name in (("c0", "churn_in"), ("c1", "churn_next"), ("c2", "churn_next2"))])


def subscription_ends_by_period(sub_fact: DataFrame, grain: str = "quarter") -> DataFrame:
    """Subscriptions whose real end_date falls in this / the next period."""
    if "end_date" not in sub_fact.columns:
        return None
    e = _counted(sub_fact.where(F.col("end_date").isNotNull() & F.col("account_id").isNotNull()), period_index("end_date", grain))
    shifts = [F.struct(F.lit(0).alias("s"), F.lit(1).alias("e0"), F.lit(0).alias("e1")),
              F.struct(F.lit(1).alias("s"), F.lit(0).alias("e0"), F.lit(1).alias("e1"))]
    x = e.select("account_id", "ev_idx", "n", F.explode(F.array(*shifts)).alias("sh"))
    return x.groupBy("account_id", (F.col("ev_idx") - F.col("sh.s")).alias("p_idx")).agg(
        *[F.sum(F.col("n") * F.col(f"sh.{c}")).cast("long").alias(name) for c, name in (("e0", "ends_in"), ("e1", "ends_next"))])


def _asof_key() -> Column:
    """The order of D7 in one long: newest start, then higher sequence number."""
    start = F.unix_date(F.col("start_date").cast("date")).cast("long")
    return F.call_function("shiftleft", start, F.lit(32)) + F.col("subscription_seq")


def _startable(sub_fact: DataFrame) -> DataFrame:
    return sub_fact.where(F.col("start_date").isNotNull() & F.col("account_id").isNotNull())


def asof_pick(sub_fact: DataFrame, bounds: DataFrame, grain: str = "quarter") -> DataFrame:
    """D7's choice per (account, period), as the key of the subscription in force
    at the period end -- ``start <= end`` and (no inferred end or inferred end
    after the period end).  A subscription is in force at the end of periods
    [p(start), p(end_inferred) - 1] (open: up to the last period).  Such spans of keys
    are dealt by account, and exploded only there, so no exploded row is shuffled; a
    long has its greatest found by a hash aggregate.  Rows of one key start alike, so
    their spans are one."""
    lo = F.greatest(period_index("start_date", grain), F.col("min_idx"))
    hi_closed = period_index("end_date_inferred", grain) - 1
    hi = F.least(F.coalesce(hi_closed, F.col("max_idx")), F.col("max_idx"))
    spans = _startable(sub_fact).crossJoin(F.broadcast(bounds)).select(
        "account_id", _asof_key().alias("asof_key"), lo.alias("lo"), hi.alias("hi")).where("hi >= lo")
    spans = spans.groupBy("account_id", "asof_key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).repartition("account_id")
    x = spans.select("account_id", "asof_key", F.explode(F.sequence("lo", "hi")).alias("p_idx"))
    return x.groupBy("account_id", "p_idx").agg(F.max("asof_key").alias("asof_key"))


def asof_payload(sub_fact: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """What a picked key stands for: (account_id, asof_key, asof), dealt by
    account.  A sequence numbers its rows once; in a fact of other making, rows of
    one key give the greatest, so a key never doubles a period."""
    s = _startable(sub_fact)
    fields = [c for c in list(COMMERCIAL_COLS) + list(extra) if c in s.columns]
    return s.select("account_id", _asof_key().alias("asof_key"), F.struct(*fields).alias("asof")) \
        .repartition("account_id").groupBy("account_id", "asof_key").agg(F.max("asof").alias("asof"))


def asof_subscription(sub_fact: DataFrame, bounds: DataFrame, grain: str = "quarter",
                      extra: tuple[str, ...] = ()) -> DataFrame:
    """The subscription in force at each period end; newest start wins, then
    the higher sequence number."""
    return asof_pick(sub_fact, bounds, grain).join(asof_payload(sub_fact, extra), ["account_id", "asof_key"]) \
        .select("account_id", "p_idx", "asof")


# ------------------------------------------------------------------ assembly

def build_panel(accounts: DataFrame, sub_fact: DataFrame, usage: DataFrame, tickets: DataFrame,
                churn: DataFrame, grain: str = "quarter", last_day_full: bool = False,
                observed_until_idx: int | None = None, carry_end_date: bool = False,
                subscriptions: DataFrame | None = None, horizons: Horizons | None = None) -> DataFrame:
    """The account x month / account x quarter panel.

    ``usage`` may be the usage fact or raw usage (then pre-aggregated before
    the subscription map).  ``observed_until_idx`` replaces the panel's last
    period as the right-censoring horizon (default: parity with the panel max);
    ``horizons`` does so by source.  ``subscriptions``: the raw table, which
    spares the sequenced fact where neither numbers nor inferred ends are used.
    """
    n = names(grain)
    raw_subs = sub_fact if subscriptions is None else subscriptions
    rng = date_range(accounts, raw_subs, usage, tickets, churn)
    bounds = bounds_literals(period_bounds(rng, grain))

    # an account's rows are kept in the order of their period ends, up to the snapshot
    spine = account_spine(accounts, bounds, grain, single=True).withColumn(n["end"], period_end("p_idx", grain))
    parts = [usage_in_account(usage_rows(usage, raw_subs, grain)),
             tickets_by_period(tickets, grain, last_day_full).repartition("account_id"),
             churn_by_period(churn, grain),
             asof_subscription(sub_fact, bounds, grain, ("end_date",) if carry_end_date else ())]
    ends = subscription_ends_by_period(raw_subs, grain)
    if ends is not None:
        parts.append(ends)

    # all are dealt by account: each has a row per (account, period) at most, which its spine row takes in
    p = spine
    for part in parts:
        values = [c for c in part.columns if c not in ("account_id", "p_idx")]
        p = p.join(part.select("account_id", period_end("p_idx", grain).alias(n["end"]), *values), ["account_id", n["end"]], "left")
    last = bounds.first()["max_idx"] if observed_until_idx is None else observed_until_idx
    return _finish_panel(p, n, grain, last, horizons)


def _finish_panel(p: DataFrame, n: dict, grain: str, observed_until_idx: int, horizons: Horizons | None) -> DataFrame:
    cols = set(p.columns)
    sub = lambda f: F.col("asof").getField(f)
    asof_fields = [f.name for f in p.schema["asof"].dataType.fields]
    active = sub("subscription_id").isNotNull()

    # what the windows read, and nothing that can be worked out after them
    values = {}
    for c, t in (("active_days", "long"), ("usage_count", "long"), ("usage_hours", "double"),
                 ("errors", "long"), ("features_used", "long"), ("tickets_opened", "long"),
                 ("escalations", "long")):
        if c in cols:
            values[c] = F.coalesce(F.col(c).cast(t), F.lit(0).cast(t))
        elif c == "tickets_opened":
            values[c] = F.lit(0).cast("long")
    values["avg_satisfaction"] = (F.col("avg_satisfaction") if "avg_satisfaction" in cols else F.lit(None)).cast("double")
    for c in ("seats", "mrr_amount", "arr_amount"):
        if c in asof_fields:
            v = sub(c).cast("double")
            values[c] = F.when(active, v).otherwise(F.coalesce(v, F.lit(0.0)))
    seen = [c for c in ("churn_in", "churn_next", "churn_next2", "ends_in", "ends_next") if c in cols]
    base = p.select("account_id", "signup_date", "p_idx", n["end"], "asof",
                    *[v.alias(c) for c, v in values.items()], *seen)
    h, history = _own_history(base, n, list(values))

    out = {"account_id": F.col("account_id"), "signup_date": F.col("signup_date"),
           n["label"]: period_label("p_idx", grain), n["start"]: period_start("p_idx", grain), n["end"]: F.col(n["end"])}
    out |= {c: F.col(c) for c in values if c not in asof_fields}
    out[n["sub_id"]] = sub("subscription_id")
    for c in ("plan_tier", "seats", "mrr_amount", "arr_amount", "billing_frequency"):
        if c in values:
            out[c] = F.col(c)
        elif c in asof_fields:
            out[c] = F.when(active, sub(c)).otherwise(F.coalesce(sub(c), F.lit("none")))
    if "end_date_inferred" in asof_fields:
        out["end_date_inferred"] = sub("end_date_inferred")
    if "end_date" in asof_fields:
        out["subscription_end_date_asof_" + n["sub_id"].split("_asof_")[1]] = sub("end_date")

    def cnt(c):
        return F.coalesce(F.col(c), F.lit(0)).cast("long") if c in seen else F.lit(0).cast("long")

    c_next, c_next2 = cnt("churn_next") > 0, cnt("churn_next2") > 0
    known1 = known2 = lambda c: c
    if grain == "quarter":
        horizon = F.lit(int(observed_until_idx))
        a1, a2 = (F.col("p_idx") + 1) <= horizon, (F.col("p_idx") + 2) <= horizon
        if horizons is not None:
            a1, a2 = horizons.label_known(F.col("p_idx"), 1), horizons.label_known(F.col("p_idx"), 2)
        known1, known2 = (lambda c: F.when(a1, c)), (lambda c: F.when(a2, c))
    out |= {n["c_cnt"]: cnt("churn_in"), n["c_in"]: cnt("churn_in") > 0,
            n["c_cnt_next"]: cnt("churn_next"), n["c_next"]: known1(c_next)}
    if n["c_next2"]:
        out[n["c_next2"]] = known2(c_next2)
    out |= {n["e_cnt"]: cnt("ends_in"), n["e_in"]: cnt("ends_in") > 0,
            n["e_cnt_next"]: cnt("ends_next"), n["e_next"]: cnt("ends_next") > 0}
    if grain == "quarter":
        out |= {"churn_label_q1_rolling": known1(c_next.cast("int")),
                "churn_label_q2_rolling": known2((c_next | c_next2).cast("int"))}
    out[n["active"]] = active
    if "end_date_inferred" in asof_fields:
        out[n["days"]] = F.when(active, F.datediff(sub("end_date_inferred"), F.col(n["end"])))
    out["satisfaction_missing_flag"] = flag((F.col("tickets_opened") > 0) & F.col("avg_satisfaction").isNull())
    out |= history
    if grain == "quarter":
        out |= {"label_available_q1": a1, "label_available_q2": a2}
    return h.select(*[v.alias(c) for c, v in out.items()])


def _own_history(p: DataFrame, n: dict, cols: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with their values of the periods before, and the own-history columns
    over them.  A rolling mean adds up the k values in force, oldest first, so the
    windows hold offsets only and no row is added up k times."""
    k, d = n["window"], n["delta"]
    w = Window.partitionBy("account_id").orderBy(n["end"])
    lags = {(c, i): f"_lag{i}_{c}" for c in BASE_DELTA_COLS if c in cols
            for i in (range(1, k) if c in ROLL_COLS else [1])}
    h = p.select("*", *[F.lag(c, i).over(w).alias(name) for (c, i), name in lags.items()])

    out = {c + d: F.col(c) - F.col(lags[c, 1]) for c in BASE_DELTA_COLS if c in cols}
    for c in (c for c in ROLL_COLS if c in cols):
        held = [F.col(lags[c, i]).cast("double") for i in range(k - 1, 0, -1)] + [F.col(c).cast("double")]
        total = reduce(lambda a, b: a + F.coalesce(b, F.lit(0.0)), held, F.lit(0.0))
        size = reduce(lambda a, b: a + b, [b.isNotNull().cast("int") for b in held])
        mean = F.when(size > 0, total / size)
        out |= {f"{c}_roll{k}_mean": mean, f"{c}_vs_roll{k}_mean": F.col(c) - mean,
                f"{c}_roll{k}_change": F.col(c) - F.col(lags[c, k - 1])}

    def c_or0(c):
        return out[c] if c in out else F.col(c) if c in cols else F.lit(0)

    out |= {"usage_drop_flag": flag((c_or0("usage_count") < c_or0(f"usage_count_roll{k}_mean")) & (c_or0("usage_count" + d) < 0)),
            "tickets_spike_flag": flag((c_or0("tickets_opened") > c_or0(f"tickets_opened_roll{k}_mean"))
                                       & (c_or0("tickets_opened" + d) > 0)),
            "downsell_flag": F.greatest(flag(c_or0("seats" + d) < 0), flag(c_or0("mrr_amount" + d) < 0))}
    return h, out


def latest_snapshot(panel: DataFrame, end_col: str) -> DataFrame:
    """Each account's row with the latest period end: the one that no row
    follows, in the order in which the panel's windows have their rows already."""
    w = Window.partitionBy("account_id").orderBy(F.col(end_col).asc_nulls_first())
    return panel.withColumn("_followed", F.lead(F.lit(True)).over(w)).where("_followed is null").drop("_followed")
