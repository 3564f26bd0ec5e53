"""Independent DuckDB formulations of every registered query.

Written straight from the reference's documented semantics (theta joins on
period windows, row_number picks, lag/rolling windows), not from the Spark
plans, so agreement is evidence.  The driver pre-registers the test tables
as views; the adapter below derives the five raw tables from them.
"""

from __future__ import annotations

ADAPTER = {
    "accounts": """
select cast(c_custkey as varchar) account_id, c_name account_name,
       lower(c_mktsegment) industry, n_name country,
       cast(date '1995-01-01' + cast(c_custkey % 1400 as int) as date) signup_date,
       case c_custkey % 3 when 0 then 'Basic' when 1 then 'Pro' else 'Enterprise' end plan_tier
from customer join nation on c_nationkey = n_nationkey""",
    "subscriptions": """
select cast(o_orderkey as varchar) subscription_id, cast(o_custkey as varchar) account_id,
       cast(o_orderdate as date) start_date,
       case when o_orderstatus <> 'O'
            then cast(cast(o_orderdate as date) + cast(90 + o_orderkey % 400 as int) as date) end end_date,
       case when o_orderpriority in ('1-URGENT','2-HIGH') then 'Enterprise'
            when o_orderpriority = '3-MEDIUM' then 'Pro' else 'Basic' end plan_tier,
       cast(1 + o_orderkey % 97 as int) seats,
       o_totalprice / 12 mrr_amount, o_totalprice arr_amount,
       case when o_orderkey % 2 = 0 then 'annual' else 'monthly' end billing_frequency,
       o_orderkey % 5 <> 0 auto_renew_flag, o_orderstatus <> 'O' churn_flag
from orders""",
    "support_tickets": """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date)) ticket_id,
       cast(o_custkey as varchar) account_id,
       cast(l_shipdate + to_hours(cast(l_linenumber * 3 as int)) as timestamp) submitted_at,
       case when l_linenumber % 3 <> 0 then cast(1 + l_partkey % 5 as int) end satisfaction_score,
       l_tax >= 0.06 escalation_flag
from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R'""",
    "churn_events": """
select cast(o_orderkey as varchar) churn_event_id, cast(o_custkey as varchar) account_id,
       cast(cast(o_orderdate as date) + 60 as date) churn_date
from orders where o_orderstatus = 'F' and o_orderpriority = '5-LOW'""",
    "feature_usage": """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date)) usage_id,
       cast(l_orderkey as varchar) subscription_id, cast(l_shipdate as date) usage_date,
       p_brand feature_name, cast(l_quantity as int) usage_count,
       cast(l_quantity * 90 as int) usage_duration_secs,
       cast(case when l_returnflag = 'A' then l_linenumber % 3 else 0 end as int) error_count
from lineitem join part on l_partkey = p_partkey""",
}

FACTS = {
    "sub_fact": """
select account_id, subscription_id, start_date, end_date,
       coalesce(end_date, next_start_date) end_date_inferred, next_start_date, subscription_seq,
       plan_tier, seats, mrr_amount, arr_amount, billing_frequency, auto_renew_flag,
       churn_flag subscription_cancel_flag
from (select *, row_number() over w subscription_seq, lead(start_date) over w next_start_date
      from subscriptions
      window w as (partition by account_id order by start_date asc nulls last, subscription_id))""",
    "usage_fact": """
select u.*, m.account_id from feature_usage u
left join (select distinct subscription_id, account_id from sub_fact) m using (subscription_id)""",
    "tickets_fact": """
select *, cast(date_trunc('day', submitted_at) as timestamp) submitted_date from support_tickets""",
    "churn_fact": """
select *, row_number() over (partition by account_id order by churn_date asc nulls last, churn_event_id) churn_seq
from churn_events""",
    "bounds": """
select min(lo) min_date, max(hi) max_date from (
  select min(signup_date) lo, max(signup_date) hi from accounts
  union all select min(usage_date), max(usage_date) from feature_usage
  union all select min(cast(submitted_at as date)), max(cast(submitted_at as date)) from support_tickets
  union all select min(start_date), max(start_date) from sub_fact
  union all select min(end_date), max(end_date) from sub_fact
  union all select min(churn_date), max(churn_date) from churn_fact)""",
}


def _idx(d: str, grain: str) -> str:
    if grain == "quarter":
        return f"(year({d}) * 4 + quarter({d}) - 1)"
    return f"(year({d}) * 12 + month({d}) - 1)"


def _calendar_cte(grain: str) -> str:
    n = 4 if grain == "quarter" else 12
    step = 12 // n
    lab = ("cast(p // 4 as varchar) || 'Q' || cast(p % 4 + 1 as varchar)" if grain == "quarter"
           else "cast(p // 12 as varchar) || '-' || lpad(cast(p % 12 + 1 as varchar), 2, '0')")
    return f"""
select p, {lab} label, make_date(cast(p // {n} as int), cast((p % {n}) * {step} + 1 as int), 1) p_start,
       last_day(make_date(cast(p // {n} as int), cast((p % {n}) * {step} + 1 as int), 1)
                + to_months({step - 1})) p_end
from (select unnest(range(cast({_idx('min_date', grain)} as bigint),
                          cast({_idx('max_date', grain)} as bigint) + 1)) p from bounds)"""


def ctes(*extra: tuple[str, str]) -> str:
    parts = list(ADAPTER.items()) + list(FACTS.items()) + list(extra)
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in parts)


def rounded(sql: str, doubles: list[str]) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"round({c}, 6) as {c}" for c in doubles)
    return f"select * replace ({rep}) from ({sql}) _q"


# ------------------------------------------------------------------ panel

BASE_DELTA = ["usage_count", "usage_hours", "active_days", "errors", "features_used",
              "tickets_opened", "escalations", "seats", "mrr_amount", "arr_amount"]
ROLL = ["usage_count", "usage_hours", "tickets_opened", "errors", "features_used", "mrr_amount", "seats"]
DOUBLE_BASE = {"usage_hours", "seats", "mrr_amount", "arr_amount"}


HORIZONS = """
select source, count(d) n_dates, min(d) first_date, max(d) last_date,
       year(min(d)) * 4 + quarter(min(d)) - 1 from_idx,
       year(max(d)) * 4 + quarter(max(d)) - 1
         - case when date_diff('day', max(d), last_day(cast(date_trunc('quarter', max(d)) as date) + interval 2 month)) < 31
                then 0 else 1 end until_idx
from (select 'accounts' source, signup_date d from accounts
      union all select 'subscriptions', start_date from subscriptions
      union all select 'feature_usage', usage_date from feature_usage
      union all select 'support_tickets', cast(submitted_at as date) from support_tickets
      union all select 'churn_events', churn_date from churn_events) group by source"""


def panel_ctes(grain: str, observed: bool = False) -> list[tuple[str, str]]:
    q = grain == "quarter"
    lab, st, en = ("quarter", "quarter_start", "quarter_end") if q else ("period", "period_start", "period_end")
    sub_id = "subscription_id_asof_qend" if q else "subscription_id_asof_period_end"
    active = "active_sub_at_qend" if q else "active_sub_at_period_end"
    days = "days_to_contract_end_asof_qend" if q else "days_to_contract_end_asof_period_end"
    w = "quarter" if q else "period"
    k = 4 if q else 3
    d = "_qoq_delta" if q else "_mom_delta"
    cal = ("cal", _calendar_cte(grain))
    # next-period ends for the last periods lie beyond the calendar: compute directly
    spine = ("spine", f"""
select a.account_id, a.signup_date, c.p, c.label, c.p_start, c.p_end,
       last_day(c.p_end + to_months({12 // (4 if q else 12)})) next_end,
       last_day(c.p_end + to_months({2 * 12 // (4 if q else 12)})) next2_end
from accounts a join cal c on c.p_end >= a.signup_date""")
    usage = ("usage_p", """
select s.account_id, s.p, count(distinct u.usage_date) active_days, cast(sum(u.usage_count) as bigint) usage_count,
       sum(u.usage_duration_secs) / 3600.0 usage_hours, cast(sum(u.error_count) as bigint) errors,
       count(distinct u.feature_name) features_used
from spine s join usage_fact u on u.account_id = s.account_id
 and u.usage_date >= s.p_start and u.usage_date <= s.p_end
group by s.account_id, s.p""")
    tickets = ("tickets_p", """
select s.account_id, s.p, count(t.ticket_id) tickets_opened,
       cast(sum(cast(t.escalation_flag as int)) as bigint) escalations,
       avg(t.satisfaction_score) avg_satisfaction
from spine s join tickets_fact t on t.account_id = s.account_id
 and t.submitted_at >= s.p_start and t.submitted_at <= s.p_end
group by s.account_id, s.p""")
    asof = ("asof_p", """
select * from (
  select s.account_id, s.p, f.subscription_id, f.plan_tier, f.seats, f.mrr_amount, f.arr_amount,
         f.billing_frequency, f.end_date_inferred,
         row_number() over (partition by s.account_id, s.p
                            order by f.start_date desc, f.subscription_seq desc) rn
  from spine s join sub_fact f on f.account_id = s.account_id and f.start_date is not null
   and f.start_date <= s.p_end and (f.end_date_inferred is null or f.end_date_inferred > s.p_end))
where rn = 1""")
    churn = ("churn_p", f"""
select s.account_id, s.p,
       count(*) filter (where c.churn_date >= s.p_start and c.churn_date <= s.p_end) c_in,
       count(*) filter (where c.churn_date > s.p_end and c.churn_date <= s.next_end) c_next,
       count(*) filter (where c.churn_date > s.next_end and c.churn_date <= s.next2_end) c_next2
from spine s join churn_fact c on c.account_id = s.account_id and c.churn_date is not null
group by s.account_id, s.p""")
    ends = ("ends_p", """
select s.account_id, s.p,
       count(*) filter (where f.end_date >= s.p_start and f.end_date <= s.p_end) e_in,
       count(*) filter (where f.end_date >= s.p_end + 1 and f.end_date <= s.next_end) e_next
from spine s join sub_fact f on f.account_id = s.account_id and f.end_date is not null
group by s.account_id, s.p""")
    label_cols = ""
    if q:
        label_cols = """,
       cast(coalesce(ch.c_next, 0) > 0 as int) churn_label_q1_rolling,
       cast(coalesce(ch.c_next, 0) > 0 or coalesce(ch.c_next2, 0) > 0 as int) churn_label_q2_rolling"""
    second = f",\n       coalesce(ch.c_next2, 0) > 0 account_churn_event_in_second_next_{w}" if q else ""
    assembled = ("assembled", f"""
select s.account_id, s.signup_date, s.label as {lab}, s.p_start {st}, s.p_end {en}, s.p,
       coalesce(u.active_days, 0) active_days, coalesce(u.usage_count, 0) usage_count,
       coalesce(u.usage_hours, 0.0) usage_hours, coalesce(u.errors, 0) errors,
       coalesce(u.features_used, 0) features_used,
       coalesce(t.tickets_opened, 0) tickets_opened, coalesce(t.escalations, 0) escalations,
       t.avg_satisfaction,
       a.subscription_id {sub_id},
       case when a.subscription_id is null then coalesce(a.plan_tier, 'none') else a.plan_tier end plan_tier,
       case when a.subscription_id is null then coalesce(cast(a.seats as double), 0.0) else cast(a.seats as double) end seats,
       case when a.subscription_id is null then coalesce(a.mrr_amount, 0.0) else a.mrr_amount end mrr_amount,
       case when a.subscription_id is null then coalesce(a.arr_amount, 0.0) else a.arr_amount end arr_amount,
       case when a.subscription_id is null then coalesce(a.billing_frequency, 'none') else a.billing_frequency end billing_frequency,
       a.end_date_inferred,
       coalesce(ch.c_in, 0) account_churn_event_count_in_{w}, coalesce(ch.c_in, 0) > 0 account_churn_event_in_{w},
       coalesce(ch.c_next, 0) account_churn_event_count_in_next_{w},
       coalesce(ch.c_next, 0) > 0 account_churn_event_in_next_{w}{second},
       coalesce(e.e_in, 0) subscription_ends_in_{w}, coalesce(e.e_in, 0) > 0 subscription_end_in_{w},
       coalesce(e.e_next, 0) subscription_ends_in_next_{w}, coalesce(e.e_next, 0) > 0 subscription_end_in_next_{w}{label_cols},
       a.subscription_id is not null {active},
       case when a.subscription_id is not null then cast(date_diff('day', s.p_end, a.end_date_inferred) as int) end {days},
       cast(coalesce(t.tickets_opened, 0) > 0 and t.avg_satisfaction is null as int) satisfaction_missing_flag
from spine s
left join usage_p u on u.account_id = s.account_id and u.p = s.p
left join tickets_p t on t.account_id = s.account_id and t.p = s.p
left join asof_p a on a.account_id = s.account_id and a.p = s.p
left join churn_p ch on ch.account_id = s.account_id and ch.p = s.p
left join ends_p e on e.account_id = s.account_id and e.p = s.p""")
    hist = []
    for c in BASE_DELTA:
        hist.append(f"{c} - lag({c}) over w {c}{d}")
    for c in ROLL:
        hist.append(f"avg({c}) over wr {c}_roll{k}_mean")
        hist.append(f"{c} - avg({c}) over wr {c}_vs_roll{k}_mean")
        hist.append(f"{c} - lag({c}, {k - 1}) over w {c}_roll{k}_change")
    history = ("history", f"""
select *, {', '.join(hist)}
from assembled
window w as (partition by account_id order by p),
       wr as (partition by account_id order by p rows between {k - 1} preceding and current row)""")
    flags = f"""
select *,
  cast(coalesce(usage_count < usage_count_roll{k}_mean and usage_count{d} < 0, false) as int) usage_drop_flag,
  cast(coalesce(tickets_opened > tickets_opened_roll{k}_mean and tickets_opened{d} > 0, false) as int) tickets_spike_flag,
  greatest(cast(coalesce(seats{d} < 0, false) as int), cast(coalesce(mrr_amount{d} < 0, false) as int)) downsell_flag
from history"""
    if q:
        final = f"""
select * exclude (p, mx, account_churn_event_in_next_quarter, account_churn_event_in_second_next_quarter,
                  churn_label_q1_rolling, churn_label_q2_rolling),
  case when p + 1 <= mx then account_churn_event_in_next_quarter end account_churn_event_in_next_quarter,
  case when p + 2 <= mx then account_churn_event_in_second_next_quarter end account_churn_event_in_second_next_quarter,
  case when p + 1 <= mx then churn_label_q1_rolling end churn_label_q1_rolling,
  case when p + 2 <= mx then churn_label_q2_rolling end churn_label_q2_rolling,
  p + 1 <= mx label_available_q1, p + 2 <= mx label_available_q2
from (select *, max(p) over () mx from ({flags}) f0) z"""
        if observed:  # a label is known as far as its sources have been observed
            until = lambda src: f"(select until_idx from horizons where source = '{src}')"
            for k in (1, 2):
                final = final.replace(f"p + {k} <= mx", f"(p + {k} <= {until('churn_events')} and p <= {until('feature_usage')} "
                                                        f"and p <= {until('support_tickets')})")
    else:
        final = f"select * exclude (p) from ({flags}) fin"
    first = [("horizons", HORIZONS)] if observed else []
    return first + [cal, spine, usage, tickets, asof, churn, ends, assembled, history, ("panel_" + grain, final)]


def panel_doubles(grain: str) -> list[str]:
    k = 4 if grain == "quarter" else 3
    d = "_qoq_delta" if grain == "quarter" else "_mom_delta"
    out = ["usage_hours", "avg_satisfaction", "seats", "mrr_amount", "arr_amount"]
    out += [c + d for c in BASE_DELTA if c in DOUBLE_BASE]
    for c in ROLL:
        out += [f"{c}_roll{k}_mean", f"{c}_vs_roll{k}_mean"]
        if c in DOUBLE_BASE:
            out.append(f"{c}_roll{k}_change")
    return out


def _panel_query(grain: str, body: str, doubles: list[str]) -> str:
    return rounded(ctes(*panel_ctes(grain)) + "\n" + body, doubles)


# ------------------------------------------------------------------ registry

def _q(sql_body: str, doubles=(), extra=()) -> str:
    return rounded(ctes(*extra) + "\n" + sql_body, list(doubles))


def oracle_queries() -> dict[str, str]:
    qcal = ("cal", _calendar_cte("quarter"))
    out = {
        "subscription_fact": _q("select * from sub_fact", ["mrr_amount", "arr_amount"]),
        "usage_fact": _q("select * from usage_fact"),
        "tickets_fact": _q("select * from tickets_fact"),
        "churn_fact": _q("select * from churn_fact"),
        "date_range": _q("select * from bounds"),
        "quarter_calendar": _q("select label as quarter, p_start quarter_start, cast(p_end as date) quarter_end from cal",
                               extra=[qcal]),
        "month_calendar": _q("select label as period, p_start period_start, cast(p_end as date) period_end from cal",
                             extra=[("cal", _calendar_cte("month"))]),
        "account_spine": _q("select a.account_id, a.signup_date, c.label as quarter from accounts a "
                            "join cal c on c.p_end >= a.signup_date", extra=[qcal]),
        "usage_by_quarter": _q(f"""
select account_id, cast({_idx('usage_date', 'quarter')} // 4 as varchar) || 'Q' ||
       cast({_idx('usage_date', 'quarter')} % 4 + 1 as varchar) as quarter,
       count(distinct usage_date) active_days, cast(sum(usage_count) as bigint) usage_count,
       sum(usage_duration_secs) / 3600.0 usage_hours, cast(sum(error_count) as bigint) errors,
       count(distinct feature_name) features_used
from usage_fact where account_id is not null and usage_date is not null group by all""", ["usage_hours"]),
        "tickets_by_quarter": _q("""
select t.account_id, c.label as quarter, count(t.ticket_id) tickets_opened,
       cast(sum(cast(t.escalation_flag as int)) as bigint) escalations, avg(t.satisfaction_score) avg_satisfaction
from tickets_fact t join cal c on t.submitted_at >= c.p_start and t.submitted_at <= c.p_end
group by all""", ["avg_satisfaction"], extra=[qcal]),
        "asof_subscription": _q("""
select account_id, label as quarter, subscription_id subscription_id_asof_qend, plan_tier, cast(seats as double) seats,
       mrr_amount, arr_amount, billing_frequency, end_date_inferred from (
  select c.label, f.*, row_number() over (partition by f.account_id, c.p
                                           order by f.start_date desc, f.subscription_seq desc) rn
  from cal c join sub_fact f on f.start_date is not null and f.start_date <= c.p_end
   and (f.end_date_inferred is null or f.end_date_inferred > c.p_end)) where rn = 1""",
                                ["seats", "mrr_amount", "arr_amount"], extra=[qcal]),
        "churn_labels": _q("""
select account_id, quarter,
       count(*) filter (where s = 0) account_churn_event_count_in_quarter,
       count(*) filter (where s = 1) account_churn_event_count_in_next_quarter,
       count(*) filter (where s = 2) > 0 account_churn_event_in_second_next_quarter
from (select c.account_id, k.s,
             cast((q - k.s) // 4 as varchar) || 'Q' || cast((q - k.s) % 4 + 1 as varchar) as quarter
      from (select account_id, year(churn_date) * 4 + quarter(churn_date) - 1 q from churn_fact
            where churn_date is not null) c
      cross join (select unnest([0, 1, 2]) s) k)
group by all"""),
        "subscription_end_labels": _q("""
select account_id, quarter,
       count(*) filter (where s = 0) subscription_ends_in_quarter,
       count(*) filter (where s = 1) subscription_ends_in_next_quarter
from (select f.account_id, k.s,
             cast((q - k.s) // 4 as varchar) || 'Q' || cast((q - k.s) % 4 + 1 as varchar) as quarter
      from (select account_id, year(end_date) * 4 + quarter(end_date) - 1 q from sub_fact
            where end_date is not null) f
      cross join (select unnest([0, 1]) s) k)
group by all"""),
        "quarter_panel": _panel_query("quarter", "select * from panel_quarter", panel_doubles("quarter")),
        "month_panel": _panel_query("month", "select * from panel_month", panel_doubles("month")),
        "latest_snapshot_quarter": _panel_query("quarter", """
select * from panel_quarter qualify row_number() over (partition by account_id order by quarter_end desc) = 1""",
                                                panel_doubles("quarter")),
        "latest_snapshot_month": _panel_query("month", """
select * from panel_month qualify row_number() over (partition by account_id order by period_end desc) = 1""",
                                              panel_doubles("month")),
        "usage_drop_quarter": _panel_query("quarter", """
select account_id, quarter, usage_count, usage_count_roll4_mean, usage_count_qoq_delta, usage_count_vs_roll4_mean
from panel_quarter where usage_drop_flag = 1""", ["usage_count_roll4_mean", "usage_count_vs_roll4_mean"]),
        "label_availability": _panel_query("quarter", """
select quarter, count(*) n_rows, bool_and(label_available_q1) label_available_q1,
       bool_and(label_available_q2) label_available_q2,
       count(churn_label_q1_rolling) n_label_q1, cast(sum(churn_label_q1_rolling) as bigint) sum_label_q1,
       count(churn_label_q2_rolling) n_label_q2, cast(sum(churn_label_q2_rolling) as bigint) sum_label_q2
from panel_quarter group by quarter""", []),
    }
    return out


# ------------------------------------------------------------------ QoQ / flags / features

QOQ = [c + "_qoq_delta" for c in BASE_DELTA]


def processed_ctes(observed: bool = False) -> list[tuple[str, str]]:
    p1 = ", ".join(f"quantile_cont(cast({c} as double), 0.01) {c}__p1, "
                   f"quantile_cont(cast({c} as double), 0.99) {c}__p99" for c in QOQ)
    clip = ", ".join(f"case when {c} is null then null else least(greatest(cast({c} as double), {c}__p1), {c}__p99) end "
                     f"{c}_clipped" for c in QOQ)
    mom = ", ".join(f"avg({c}_clipped) {c}__mean, stddev_pop({c}_clipped) {c}__std" for c in QOQ)
    z = ", ".join(f"case when {c}__std is null or isnan({c}__std) or {c}__std = 0 then 0.0 "
                  f"else ({c}_clipped - {c}__mean) / {c}__std end {c}_z, "
                  f"cast(coalesce({c} < 0, false) as int) {c}_drop_flag" for c in QOQ)
    stat_cols = ", ".join(f"{c}__p1, {c}__p99, {c}__mean, {c}__std" for c in QOQ)
    return panel_ctes("quarter", observed) + [
        ("qstats", f"select {p1} from panel_quarter"),
        ("clipped", f"select p.*, qstats.*, {clip} from panel_quarter p cross join qstats"),
        ("mstats", f"select {mom} from clipped"),
        ("qoq", f"select * exclude ({stat_cols}), {z} from clipped cross join mstats"),
        ("processed", """
select q.*, cast(q.days_to_contract_end_asof_qend is null as int) contract_missing_flag,
       cast(coalesce(sf.end_date, q.end_date_inferred, sf.end_date_inferred) as date) effective_end_date,
       cast(sf.end_date is not null as int) contract_end_observed_flag,
       cast(coalesce(sf.end_date, q.end_date_inferred, sf.end_date_inferred) is not null
            and sf.end_date is null as int) contract_end_inferred_flag
from qoq q left join sub_fact sf on sf.subscription_id = q.subscription_id_asof_qend"""),
    ]


def _proc(body: str, doubles=()) -> str:
    return rounded(ctes(*processed_ctes()) + "\n" + body, list(doubles))


FEATURE_SQL = """
features as (
  select *, tenure_z * cast(usage_drop_flag as double) tenure_x_usage_drop_flag,
         tenure_z * tickets_opened_qoq_delta_z tenure_x_tickets_opened_qoq_delta_z
  from (
    select b.*, case when s.sd is null or s.sd <= 1e-12 then 0.0 else (b.tenure - s.mu) / s.sd end tenure_z
    from (
      select account_id, quarter, quarter_end, churn_label_q1_rolling,
             coalesce(usage_count_qoq_delta_z, 0.0) usage_count_qoq_delta_z,
             coalesce(tickets_opened_qoq_delta_z, 0.0) tickets_opened_qoq_delta_z,
             least(coalesce(cast(days_to_contract_end_asof_qend as double), 365.0), 365.0) days_to_contract_end_capped,
             coalesce(arr_amount_qoq_delta_z, 0.0) arr_amount_qoq_delta_z,
             coalesce(seats_qoq_delta_z, 0.0) seats_qoq_delta_z,
             coalesce(seats, 0.0) seats,
             cast((year(quarter_end) * 4 + quarter(quarter_end)) - (year(signup_date) * 4 + quarter(signup_date)) + 1
                  as double) tenure,
             avg_satisfaction, satisfaction_missing_flag, contract_missing_flag,
             usage_drop_flag,
             cast(coalesce(cast(days_to_contract_end_asof_qend as double), 365.0) <= 90 as int) contract_ending_soon_flag,
             coalesce(plan_tier, 'unknown') plan_tier
      from processed) b
    cross join (select avg(tenure) mu, stddev_samp(tenure) sd from (
      select cast((year(quarter_end) * 4 + quarter(quarter_end)) - (year(signup_date) * 4 + quarter(signup_date)) + 1
                  as double) tenure from processed)) s))"""

FEATURE_COLS = ["usage_count_qoq_delta_z", "tickets_opened_qoq_delta_z", "days_to_contract_end_capped",
                "arr_amount_qoq_delta_z", "seats_qoq_delta_z", "seats", "tenure", "tenure_z",
                "tenure_x_usage_drop_flag", "tenure_x_tickets_opened_qoq_delta_z", "avg_satisfaction",
                "satisfaction_missing_flag", "contract_missing_flag", "usage_drop_flag",
                "contract_ending_soon_flag", "plan_tier"]
FEATURE_DOUBLES = [c for c in FEATURE_COLS if c not in (
    "satisfaction_missing_flag", "contract_missing_flag", "usage_drop_flag", "contract_ending_soon_flag", "plan_tier")]


def _feat(body: str, doubles=()) -> str:
    return rounded(ctes(*processed_ctes()) + ",\n" + FEATURE_SQL + "\n" + body, list(doubles))


def oracle_queries_efgm() -> dict[str, str]:
    qcols = []
    dbl = []
    for c in QOQ:
        qcols += [c, f"{c}_clipped", f"{c}_z", f"{c}_drop_flag"]
        dbl += [f"{c}_clipped", f"{c}_z"] + ([c] if c.replace("_qoq_delta", "") in DOUBLE_BASE else [])
    summary_rows = " union all ".join(
        f"select '{c}' feature, {c}__p1 p1, {c}__p99 p99, {c}__mean mean_clipped, {c}__std std_clipped, "
        f"(select avg(cast(coalesce({c} < 0, false) as double)) from panel_quarter) pct_negative "
        f"from qstats cross join mstats" for c in QOQ)
    flags = ["satisfaction_missing_flag", "contract_missing_flag", "contract_end_observed_flag",
             "contract_end_inferred_flag"]
    flag_long = " union all ".join(f"select '{f}' flag, cast({f} as int) value from processed" for f in flags)
    return {
        "qoq_processed": _proc(f"select account_id, quarter, {', '.join(qcols)} from processed", dbl),
        "qoq_summary": _proc(summary_rows, ["p1", "p99", "mean_clipped", "std_clipped", "pct_negative"]),
        "missing_flags": _proc("select account_id, quarter, satisfaction_missing_flag, contract_missing_flag from processed"),
        "contract_flags": _proc("select account_id, quarter, subscription_id_asof_qend, effective_end_date, "
                                "contract_end_observed_flag, contract_end_inferred_flag from processed"),
        "flag_distribution": _proc(f"""
select l.flag, l.value, count(*) n, t.rows, count(*) / t.rows share
from ({flag_long}) l join (select '{flags[0]}' flag, count(*) rows from processed
  union all select '{flags[1]}', count(*) from processed union all select '{flags[2]}', count(*) from processed
  union all select '{flags[3]}', count(*) from processed) t using (flag)
group by l.flag, l.value, t.rows""", ["share"]),
        "contract_sanity": _proc("""
select count(*) rows,
       count(*) filter (where contract_end_inferred_flag = 1 and contract_end_observed_flag = 1) both_flags,
       count(*) filter (where effective_end_date is null) null_effective_end from processed"""),
        "label_backfill": _proc("""
select account_id, quarter, cast(account_churn_event_in_next_quarter as int) churn_label_q1_rolling,
       cast(account_churn_event_in_next_quarter or account_churn_event_in_second_next_quarter as int)
         churn_label_q2_rolling
from processed"""),
        "feature_set": _feat("select account_id, quarter, quarter_end, churn_label_q1_rolling, "
                             + ", ".join(FEATURE_COLS) + " from features", FEATURE_DOUBLES),
        "panel_shape": _panel_query("quarter", """
select count(*) n_rows, (select count(*) from (describe panel_quarter)) n_cols,
       count(distinct account_id) n_accounts, count(distinct cast(quarter_end as varchar)) n_quarters
from panel_quarter""", []),
        "label_rate": _panel_query("quarter", """
select 'account_churn_event_in_next_quarter' label, avg(cast(account_churn_event_in_next_quarter as double)) rate,
       count(account_churn_event_in_next_quarter) n from panel_quarter
union all
select 'churn_label_q2_rolling', avg(cast(churn_label_q2_rolling as double)), count(churn_label_q2_rolling)
from panel_quarter""", ["rate"]),
        "label_rate_by_quarter": _panel_query("quarter", """
select 'account_churn_event_in_next_quarter' label, quarter_end quarter_key,
       avg(cast(account_churn_event_in_next_quarter as double)) rate, count(*) n
from panel_quarter where account_churn_event_in_next_quarter is not null group by quarter_end
union all
select 'churn_label_q2_rolling', quarter_end, avg(cast(churn_label_q2_rolling as double)), count(*)
from panel_quarter where churn_label_q2_rolling is not null group by quarter_end""", ["rate"]),
        "missing_rates": _panel_query("quarter", """
select 'usage_count' "column", avg(cast(usage_count is null as double)) missing_rate from panel_quarter
union all select 'tickets_opened', avg(cast(tickets_opened is null as double)) from panel_quarter
union all select 'arr_amount', avg(cast(arr_amount is null as double)) from panel_quarter
union all select 'seats', avg(cast(seats is null as double)) from panel_quarter""", ["missing_rate"]),
        "duplicate_keys": _panel_query("quarter", """
select cast(coalesce(sum(n - 1), 0) as bigint) duplicate_rows
from (select account_id, quarter_end, count(*) n from panel_quarter group by all)""", []),
    }


_base_oracle = oracle_queries_panel = oracle_queries


def oracle_queries() -> dict[str, str]:  # noqa: F811
    out = _base_oracle()
    out.update(oracle_queries_efgm())
    return out


# ------------------------------------------------------------------ evaluation / risk (fixed scorer)

def _scorer_terms():
    """The fixed scorer's literal parameters (inputs of the check, not logic)."""
    from churnlens.operators.model import fixed_scorer
    return fixed_scorer()


def _transformed_sql(t) -> str:
    if t.kind == "num":
        return f"((coalesce(cast({t.base} as double), {float(t.impute)!r}) - {t.mean!r}) / {t.scale!r})"
    if t.kind == "bin":
        return f"coalesce(cast({t.base} as double), {float(t.impute)!r})"
    return f"(case when coalesce({t.base}, '{t.impute}') = '{t.level}' then 1.0 else 0.0 end)"


def _term_sql(t) -> str:
    if t.kind == "num":
        return f"((coalesce(cast({t.base} as double), {float(t.impute)!r}) - {t.mean!r}) / {t.scale!r}) * {t.coef!r}"
    if t.kind == "bin":
        return f"coalesce(cast({t.base} as double), {float(t.impute)!r}) * {t.coef!r}"
    return (f"(case when coalesce({t.base}, '{t.impute}') = '{t.level}' then 1.0 else 0.0 end) * {t.coef!r}")


def _prob_sql(spec=None) -> str:
    s = spec or _scorer_terms()
    margin = " + ".join([repr(float(s.intercept))] + [_term_sql(t) for t in s.terms])
    return f"1.0 / (1.0 + exp(-({margin})))"


def _contrib_sql(base: str, spec=None) -> str:
    s = spec or _scorer_terms()
    parts = [_term_sql(t) for t in s.terms if t.base == base]
    return " + ".join(parts) if parts else "0.0"


SPLIT_SQL = """
labelled as (select *, year(quarter_end) * 4 + quarter(quarter_end) - 1 qi from features
             where churn_label_q1_rolling is not null),
validq as (select distinct qi from labelled order by qi desc limit 2),
split as (select l.*, case when l.qi in (select qi from validq) then 'valid' else 'train' end split from labelled l)"""


def _eval(body: str, doubles=(), observed: bool = False, spec=None) -> str:
    sql = (ctes(*processed_ctes(observed)) + ",\n" + FEATURE_SQL + ",\n" + SPLIT_SQL + f""",
vscored as (select account_id, quarter, cast(churn_label_q1_rolling as int) label, {_prob_sql(spec)} p
            from split where split = 'valid')
""" + body)
    return rounded(sql, list(doubles))


def _risk_body(spec=None) -> str:
    a = _contrib_sql("usage_count_qoq_delta_z", spec)
    b = _contrib_sql("tickets_opened_qoq_delta_z", spec)
    c = _contrib_sql("arr_amount_qoq_delta_z", spec)
    return f"""
, latest as (select *, {_prob_sql(spec)} p0, {a} ca, {b} cb, {c} cc from features
             qualify quarter_end = max(quarter_end) over (partition by account_id)),
ranked as (select *,
  1 + cast(cb > ca as int) + cast(cc > ca as int) ra,
  1 + cast(ca >= cb as int) + cast(cc > cb as int) rb,
  1 + cast(ca >= cc as int) + cast(cb >= cc as int) rc from latest),
named as (select *,
  case 1 when ra then 'Usage decline' when rb then 'Support pressure' else 'Commercial contraction' end d1,
  case 2 when ra then 'Usage decline' when rb then 'Support pressure' else 'Commercial contraction' end d2,
  case 3 when ra then 'Usage decline' when rb then 'Support pressure' else 'Commercial contraction' end d3
  from ranked),
risk as (select account_id, p0 churn_probability_q1, p0 churn_prob_q1,
  1 - pow(1 - p0, 2) churn_prob_q2, 1 - pow(1 - p0, 3) churn_prob_q3, 1 - pow(1 - p0, 4) churn_prob_q4,
  case when p0 >= 0.35 then '0-90 days' when 1 - pow(1 - p0, 2) >= 0.35 then '3-6 months'
       when 1 - pow(1 - p0, 3) >= 0.35 then '6-12 months' when 1 - pow(1 - p0, 4) >= 0.35 then '> 365 days'
       else 'N/A' end churn_date_window,
  1 - pow(1 - p0, 2) churn_prob_within_2q, 1 - pow(1 - p0, 4) churn_prob_within_4q,
  cast(round_even(p0 * 100, 0) as int) risk_score,
  case when p0 >= 0.5 then 'High' when p0 >= 0.35 then 'Medium' else 'Low' end risk_tier,
  case when abs(ca) >= abs(cb) and abs(ca) >= abs(cc) then 'Usage Risk'
       when abs(cb) >= abs(cc) then 'Support Risk' else 'Commercial Risk' end risk_type,
  cast((year(quarter_end) * 4 + quarter(quarter_end)) // 4 as varchar) || 'Q' ||
    cast((year(quarter_end) * 4 + quarter(quarter_end)) % 4 + 1 as varchar) predicted_churn_quarter,
  d1 || ', ' || d2 || ', ' || d3 top_drivers,
  (case d1 when 'Usage decline' then 'Usage re-engagement / training'
           when 'Support pressure' then 'Proactive support / escalation review'
           else 'Commercial check-in' end) || ' / ' ||
  (case d2 when 'Usage decline' then 'Usage re-engagement / training'
           when 'Support pressure' then 'Proactive support / escalation review'
           else 'Commercial check-in' end) recommended_action
  from named)
"""


RISK_DOUBLES = ["churn_probability_q1", "churn_prob_q1", "churn_prob_q2", "churn_prob_q3", "churn_prob_q4",
                "churn_prob_within_2q", "churn_prob_within_4q"]


def oracle_queries_hi() -> dict[str, str]:
    return {
        "time_split": _eval("""
select cast(qi // 4 as varchar) || 'Q' || cast(qi % 4 + 1 as varchar) as quarter, split, count(*) n_rows,
       cast(sum(churn_label_q1_rolling) as bigint) n_pos from split group by all"""),
        "roc_auc": _eval("""
select case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (cum_neg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) end
       validation_auc
from (select p, sum(label) pos, sum(1 - label) neg,
             sum(sum(1 - label)) over (order by p rows between unbounded preceding and current row) cum_neg
      from vscored group by p)""", ["validation_auc"]),
        "threshold_metrics": _eval("""
select case when count(*) filter (where p >= 0.5) > 0
            then (count(*) filter (where p >= 0.5 and label = 1)) / (count(*) filter (where p >= 0.5)) else 0.0 end
       validation_precision_at_0_5,
       case when count(*) filter (where label = 1) > 0
            then (count(*) filter (where p >= 0.5 and label = 1)) / (count(*) filter (where label = 1)) else 0.0 end
       validation_recall_at_0_5
from vscored""", ["validation_precision_at_0_5", "validation_recall_at_0_5"]),
        "rank_metrics": _eval("""
, ordered as (select row_number() over (order by p desc, account_id, quarter) k,
                     sum(label) over (order by p desc, account_id, quarter rows between unbounded preceding and current row) tp
              from vscored),
tot as (select count(*) n, sum(label) pp, ceil(count(*) * 0.05) k5, ceil(count(*) * 0.10) k10,
               ceil(count(*) * 0.20) k20 from vscored),
m as (select o.k, o.tp / o.k prec, case when t.pp > 0 then o.tp / t.pp else 0.0 end rec, t.* from ordered o, tot t)
select max(prec) filter (where k = k5) precision_top5, max(rec) filter (where k = k5) recall_top5,
       max(prec) filter (where k = k10) precision_top10, max(rec) filter (where k = k20) recall_top20,
       case when max(pp) / max(n) > 0 then max(prec) filter (where k = k10) / (max(pp) / max(n)) end lift_top10,
       max(prec) best_precision_at_k, arg_min(k, -prec * 1e12 + k) best_precision_k_unused,
       max(rec) best_recall_at_k
from m""".replace(", arg_min(k, -prec * 1e12 + k) best_precision_k_unused", "")
                              .replace("select max(prec) filter (where k = k5)",
                                       "select *, (select min(k) from m where prec = (select max(prec) from m)) best_precision_k, "
                                       "(select min(k) from m where rec = (select max(rec) from m)) best_recall_k from (select max(prec) filter (where k = k5)")
                              + ") z",
                              ["precision_top5", "recall_top5", "precision_top10", "recall_top20", "lift_top10",
                               "best_precision_at_k", "best_recall_at_k"]),
        "class_weights": _eval("""
select label, n, case label when 0 then 1.0 when 1 then 2.0 else 1.0 end weight, 'given' scheme
from (select cast(churn_label_q1_rolling as int) label, count(*) n from split where split = 'train' group by 1)
union all
select label, n, (sum(n) over ()) / ((count(*) over ()) * n) weight, 'balanced'
from (select cast(churn_label_q1_rolling as int) label, count(*) n from split where split = 'train' group by 1)""",
                               ["weight"]),
        "validation_report": _eval("""
select count(*) filter (where split = 'valid') validation_sample_count,
       avg(cast(churn_label_q1_rolling as double)) filter (where split = 'valid') validation_positive_rate,
       avg(1 - cast(churn_label_q1_rolling as double)) filter (where split = 'valid') validation_negative_rate,
       (select string_agg(q, ',' order by q) from (select distinct cast(qi // 4 as varchar) || 'Q' ||
               cast(qi % 4 + 1 as varchar) q from split where split = 'train')) train_quarters,
       (select string_agg(q, ',' order by q) from (select distinct cast(qi // 4 as varchar) || 'Q' ||
               cast(qi % 4 + 1 as varchar) q from split where split = 'valid')) valid_quarters,
       count(*) filter (where split = 'train') n_train, count(*) filter (where split = 'valid') n_valid
from split""", ["validation_positive_rate", "validation_negative_rate"]),
        "latest_risk": _eval(_risk_body() + "select * from risk", RISK_DOUBLES),
        "demo_output": _eval(_risk_body() + """
select account_id, churn_probability_q1, churn_prob_q1, churn_prob_q2, churn_prob_q3, churn_prob_q4,
       churn_date_window, risk_tier, risk_type, predicted_churn_quarter, top_drivers key_risks,
       recommended_action recommended_actions from risk""", RISK_DOUBLES[:5]),
        "example_upload": _proc("""
select account_id, usage_count_qoq_delta_z, tickets_opened_qoq_delta_z, usage_drop_flag, arr_amount_qoq_delta_z,
       seats_qoq_delta_z, seats, avg_satisfaction, satisfaction_missing_flag, contract_missing_flag, plan_tier,
       mrr_amount
from processed qualify quarter_end = max(quarter_end) over (partition by account_id)""",
                                ["usage_count_qoq_delta_z", "tickets_opened_qoq_delta_z", "arr_amount_qoq_delta_z",
                                 "seats_qoq_delta_z", "seats", "avg_satisfaction", "mrr_amount"]),
    }


_efgm_oracle = oracle_queries


def oracle_queries() -> dict[str, str]:  # noqa: F811
    out = _efgm_oracle()
    out.update(oracle_queries_hi())
    return out


# ------------------------------------------------------------------ uploads / explanations / report

TODAY = "date '2001-06-30'"


def _qe(d: str) -> str:
    return f"cast(last_day(cast(date_trunc('quarter', {d}) as date) + interval 2 month) as date)"


FIXTURE_CTES = """
qfix as (select account_id, quarter_start as_of_quarter, usage_count usage_count_total, tickets_opened ticket_count,
                avg_satisfaction avg_csat, escalations escalation_count,
                days_to_contract_end_asof_qend days_to_contract_end, plan_tier, seats, arr_amount, mrr_amount,
                signup_date from panel_quarter),
obs as (select max(as_of_quarter) mx from qfix where usage_count_total > 0),
hist as (select * from qfix where as_of_quarter <> (select mx from obs)),
newq as (select * from qfix where as_of_quarter = (select mx from obs)),
sfix0 as (select account_id, plan_tier, signup_date, quarter_end as_of_date, quarter_start,
                 usage_count usage_count_current, lag(usage_count) over w usage_count_prev,
                 tickets_opened tickets_opened_current, lag(tickets_opened) over w tickets_opened_prev,
                 days_to_contract_end_asof_qend days_to_contract_end_current,
                 seats seats_current, lag(seats) over w seats_prev,
                 arr_amount arr_current, lag(arr_amount) over w arr_prev,
                 avg_satisfaction avg_satisfaction_current
          from panel_quarter window w as (partition by account_id order by quarter_end)),
sfix as (select * exclude (quarter_start) from sfix0)"""


def single_builder(src: str, prefix: str) -> str:
    """CTEs turning a single-wide input ``src`` into meta + the 16 features."""
    p = prefix
    return f"""
{p}a as (select cast(account_id as varchar) account_id, signup_date, as_of_date, {_qe('as_of_date')} quarter_end,
               0 signup_date_inferred_flag, 0 as_of_date_inferred_flag,
               coalesce(cast(usage_count_current as double), 0) - coalesce(cast(usage_count_prev as double), 0) du,
               coalesce(cast(tickets_opened_current as double), 0) - coalesce(cast(tickets_opened_prev as double), 0) dt,
               coalesce(cast(seats_current as double), 0) - coalesce(cast(seats_prev as double), 0) ds,
               coalesce(cast(arr_current as double), 0) - coalesce(cast(arr_prev as double), 0) da,
               coalesce(cast(seats_current as double), 0) seats,
               cast(days_to_contract_end_current as double) d,
               cast(avg_satisfaction_current as double) sat, cast(plan_tier as varchar) plan_tier
        from {src}),
{p}s as (select avg(du) mu, stddev_pop(du) su, avg(dt) mt, stddev_pop(dt) st, avg(ds) ms, stddev_pop(ds) ss,
                avg(da) ma, stddev_pop(da) sa from {p}a),
{p}b as (select a.*,
    case when su is null or isnan(su) or su <= 1e-12 then 0.0 else (du - mu) / su end usage_count_qoq_delta_z,
    case when st is null or isnan(st) or st <= 1e-12 then 0.0 else (dt - mt) / st end tickets_opened_qoq_delta_z,
    case when sa is null or isnan(sa) or sa <= 1e-12 then 0.0 else (da - ma) / sa end arr_amount_qoq_delta_z,
    case when ss is null or isnan(ss) or ss <= 1e-12 then 0.0 else (ds - ms) / ss end seats_qoq_delta_z,
    cast((year(quarter_end) * 4 + quarter(quarter_end)) - (year(signup_date) * 4 + quarter(signup_date)) + 1
         as double) tenure
  from {p}a a cross join {p}s),
{p}c as (select b.*, case when t.sd is null or t.sd <= 1e-12 then 0.0 else (b.tenure - t.mt2) / t.sd end tenure_z
         from {p}b b cross join (select avg(tenure) mt2, stddev_samp(tenure) sd from {p}b) t),
{p}f as (select account_id, signup_date, as_of_date, quarter_end, signup_date_inferred_flag, as_of_date_inferred_flag,
    usage_count_qoq_delta_z, tickets_opened_qoq_delta_z, least(coalesce(d, 365.0), 365.0) days_to_contract_end_capped,
    arr_amount_qoq_delta_z, seats_qoq_delta_z, seats, tenure, tenure_z,
    tenure_z * cast(cast(du < 0 as int) as double) tenure_x_usage_drop_flag,
    tenure_z * tickets_opened_qoq_delta_z tenure_x_tickets_opened_qoq_delta_z,
    sat avg_satisfaction, cast(sat is null as int) satisfaction_missing_flag, cast(d is null as int) contract_missing_flag,
    cast(du < 0 as int) usage_drop_flag, cast(coalesce(d, 365.0) <= 90 as int) contract_ending_soon_flag,
    coalesce(plan_tier, 'unknown') plan_tier
  from {p}c)"""


META_COLS = ["account_id", "signup_date", "as_of_date", "quarter_end", "signup_date_inferred_flag",
             "as_of_date_inferred_flag"]
UPLOAD_DOUBLES = [c for c in FEATURE_DOUBLES]


def _upload(extra_ctes: str, body: str, doubles=()) -> str:
    sql = ctes(*panel_ctes("quarter")) + ",\n" + FIXTURE_CTES + ",\n" + extra_ctes + "\n" + body
    return rounded(sql, list(doubles))


MULTI_CTES = f"""
anchor as (select {_qe('a')} as_of_date, year({_qe('a')}) * 4 + quarter({_qe('a')}) - 1 qc from (
  select coalesce(max(d), {TODAY}) a from (
    select max(start_date) d from subscriptions
    union all select case when max(end_date) is not null then least(max(end_date), {TODAY}) end from subscriptions
    union all select max(usage_date) from feature_usage
    union all select max(cast(submitted_at as date)) from support_tickets))),
lsub as (select account_id, subscription_id, end_date, plan_tier, seats, arr_amount from subscriptions
         qualify row_number() over (partition by account_id order by end_date desc nulls first, subscription_id desc) = 1),
mu as (select subscription_id,
              sum(usage_count) filter (where year(usage_date) * 4 + quarter(usage_date) - 1 = (select qc from anchor)) uc,
              sum(usage_count) filter (where year(usage_date) * 4 + quarter(usage_date) - 1 = (select qc from anchor) - 1) up
       from feature_usage group by subscription_id),
mt as (select account_id,
              count(*) filter (where year(submitted_at) * 4 + quarter(submitted_at) - 1 = (select qc from anchor)) tc,
              count(*) filter (where year(submitted_at) * 4 + quarter(submitted_at) - 1 = (select qc from anchor) - 1) tp,
              avg(satisfaction_score) filter (where year(submitted_at) * 4 + quarter(submitted_at) - 1
                                               = (select qc from anchor)) sc
       from support_tickets group by account_id),
multi_in as (select l.account_id, a.signup_date, (select as_of_date from anchor) as_of_date, l.plan_tier,
                    coalesce(mu.uc, 0) usage_count_current, coalesce(mu.up, 0) usage_count_prev,
                    coalesce(mt.tc, 0) tickets_opened_current, coalesce(mt.tp, 0) tickets_opened_prev,
                    date_diff('day', (select as_of_date from anchor), l.end_date) days_to_contract_end_current,
                    l.seats seats_current, l.seats seats_prev, l.arr_amount arr_current, l.arr_amount arr_prev,
                    mt.sc avg_satisfaction_current
             from lsub l left join accounts a using (account_id) left join mu using (subscription_id)
             left join mt using (account_id)),""" + single_builder("multi_in", "m_")

QUARTERLY_CTES = f"""
prevq as (select account_id, usage_count_total usage_count_total_prevq, ticket_count ticket_count_prevq,
                 avg_csat avg_csat_prevq, seats seats_prevq, arr_amount arr_amount_prevq from hist
          where as_of_quarter < (select mx from obs)
          qualify as_of_quarter = max(as_of_quarter) over (partition by account_id)),
q_in as (select n.account_id, n.plan_tier, coalesce(n.usage_count_total, 0) usage_count_current,
                coalesce(p.usage_count_total_prevq, 0) usage_count_prev, coalesce(n.ticket_count, 0) tickets_opened_current,
                coalesce(p.ticket_count_prevq, 0) tickets_opened_prev, n.days_to_contract_end days_to_contract_end_current,
                coalesce(n.seats, 0) seats_current, coalesce(p.seats_prevq, 0) seats_prev,
                coalesce(n.arr_amount, 0) arr_current, coalesce(p.arr_amount_prevq, 0) arr_prev,
                n.avg_csat avg_satisfaction_current, {_qe('n.as_of_quarter')} as_of_date, n.signup_date
         from newq n left join prevq p using (account_id)),""" + single_builder("q_in", "q_") + """,
meds as (select account_id, median(usage_count_total) hist_usage_median, median(ticket_count) hist_tickets_median,
                median(avg_csat) hist_csat_median, cast(null as double) hist_resolution_median,
                cast(null as double) hist_first_response_median from hist group by account_id),
feats2 as (select f.*, n.as_of_quarter, n.usage_count_total, n.ticket_count, n.avg_csat,
                  cast(null as double) avg_resolution_hours, cast(null as double) avg_first_response_minutes,
                  n.escalation_count, cast(null as double) auto_renew_flag, n.days_to_contract_end,
                  m.hist_usage_median, m.hist_tickets_median, m.hist_csat_median, m.hist_resolution_median,
                  m.hist_first_response_median, n.plan_tier plan_tier_enrich, n.seats seats_enrich, n.arr_amount,
                  n.mrr_amount
           from q_f f left join newq n using (account_id) left join meds m using (account_id))"""


def _fmt(x: str, d: int) -> str:
    return f"printf('%.{d}f', cast({x} as double))"


EXPLAIN_SELF = """
self_x as (select *,
  coalesce(usage_count_total <= 0.8 * hist_usage_median, false) or coalesce(usage_drop_flag, 0) = 1 usage_flag,
  nullif(concat_ws(' ', case when coalesce(usage_drop_flag, 0) = 1 then 'Usage declined vs previous quarter.' end,
    case when coalesce(usage_count_total <= 0.8 * hist_usage_median, false) then
      'Usage is below its historical baseline (current ' || """ + _fmt("usage_count_total", 0) + """ ||
      ' vs baseline ~' || """ + _fmt("hist_usage_median", 0) + """ || ').' end), '') usage_txt,
  coalesce(ticket_count >= 1.3 * hist_tickets_median, false) or coalesce(escalation_count, 0) > 0
    or coalesce(tickets_opened_qoq_delta_z, 0) > 0.6 support_flag,
  nullif(concat_ws(' ', case when coalesce(escalation_count, 0) > 0 then 'Escalations detected in the quarter.' end,
    case when coalesce(ticket_count >= 1.3 * hist_tickets_median, false) then
      'Ticket volume is above its historical baseline (current ' || """ + _fmt("ticket_count", 0) + """ ||
      ' vs baseline ~' || """ + _fmt("hist_tickets_median", 0) + """ || ').'
      when coalesce(tickets_opened_qoq_delta_z, 0) > 0.6 then 'Support ticket activity increased vs previous quarter.'
    end), '') support_txt,
  coalesce(avg_csat <= 2.5, false) or coalesce(hist_csat_median - avg_csat >= 0.5, false) sat_flag,
  case when avg_csat is not null then nullif(concat_ws(' ',
    case when avg_csat <= 2.5 then 'Satisfaction is low (avg CSAT ~' || """ + _fmt("avg_csat", 1) + """ || ').' end,
    case when hist_csat_median - avg_csat >= 0.5 then
      'Satisfaction dropped vs its baseline (baseline ~' || """ + _fmt("hist_csat_median", 1) + """ || ').' end),
    '') end sat_txt,
  coalesce(days_to_contract_end_capped, 365.0) <= 90 comm_flag,
  case when coalesce(days_to_contract_end_capped, 365.0) <= 90 then
    'Contract renewal is within 90 days (ending in ~' || cast(trunc(coalesce(days_to_contract_end_capped, 365.0)) as bigint)
    || ' days).' || case when coalesce(auto_renew_flag = 0, false) then ' Auto-renew is OFF.' else '' end end comm_txt
from feats2)"""


def _peer_sql(src: str) -> str:
    pr = lambda v: (f"((rank() over (order by {v}) - 1) + (count(*) over (partition by {v}) + 1) / 2.0)"  # noqa: E731
                    f" / count(*) over ()")
    return f"""
peer0 as (select *, coalesce(usage_count_qoq_delta_z, 0.0) uz, coalesce(tickets_opened_qoq_delta_z, 0.0) tz,
                 coalesce(avg_satisfaction, (select coalesce(median(avg_satisfaction), 3.0) from {src})) satf
          from {src}),
peer1 as (select *, {pr('uz')} uz_pct, {pr('tz')} tz_pct, {pr('satf')} sat_pct from peer0),
peer_x as (select *,
  coalesce(usage_drop_flag, 0) = 1 or uz_pct <= 0.2 usage_flag,
  nullif(concat_ws(' ', case when coalesce(usage_drop_flag, 0) = 1 then 'Usage trend is declining vs previous quarter.' end,
    case when uz_pct <= 0.2 then 'Usage is in the bottom range compared to peers in this upload.' end), '') usage_txt,
  tz_pct >= 0.8 or tz > 0.6 support_flag,
  nullif(concat_ws(' ', case when tz > 0.6 then 'Support ticket activity is increasing vs previous quarter.' end,
    case when tz_pct >= 0.8 then 'Ticket increase is in the top range compared to peers in this upload.' end), '')
    support_txt,
  coalesce(avg_satisfaction <= 2.5, false) or (sat_pct <= 0.2 and avg_satisfaction is not null) sat_flag,
  case when avg_satisfaction is not null then nullif(concat_ws(' ',
    case when avg_satisfaction <= 2.5 then 'Satisfaction is low (avg CSAT ~' || {_fmt('avg_satisfaction', 1)} || ').' end,
    case when sat_pct <= 0.2 then 'Satisfaction is in the bottom range compared to peers in this upload.' end), '')
    end sat_txt,
  coalesce(days_to_contract_end_capped, 365.0) <= 90 comm_flag,
  case when coalesce(days_to_contract_end_capped, 365.0) <= 90 then
    'Contract renewal is within 90 days (ending in ~' || cast(trunc(coalesce(days_to_contract_end_capped, 365.0)) as bigint)
    || ' days).' end comm_txt
from peer1)"""


def _scored_sql(src: str = "self_x", context: str | None = None) -> str:
    reco = ("case risk_type when 'Commercial' then 'Focus: Commercial | Confirm renewal timeline, decision makers, and "
            "success criteria. Align early on the renewal plan.' when 'Usage' then 'Focus: Usage | Identify which "
            "workflows/features dropped (by role/team). Run enablement and adoption recovery.' when 'Support' then "
            "'Focus: Support | Review recurring themes and known issues. Validate SLA/response quality and close-loop "
            "with the customer.' when 'Satisfaction' then 'Focus: Success | Confirm stakeholder sentiment and run a "
            "recovery plan. Identify top pain points.' else 'Focus: General | Validate health signals and request "
            "missing data fields if needed.' end")
    context = context or """seats, as_of_date, signup_date, quarter_end, signup_date_inferred_flag, as_of_date_inferred_flag, as_of_quarter,
  usage_count_total, ticket_count, avg_csat, days_to_contract_end, auto_renew_flag, escalation_count,
  hist_usage_median, hist_tickets_median, hist_csat_median, plan_tier"""
    return f"""
sc0 as (select *, {_prob_sql()} risk_probability,
  case when comm_flag then 'Commercial' when usage_flag then 'Usage' when support_flag then 'Support'
       when sat_flag then 'Satisfaction' else 'General' end risk_type,
  list_filter([case when comm_flag then comm_txt end, case when usage_flag then usage_txt end,
               case when support_flag then support_txt end, case when sat_flag then sat_txt end],
              lambda x: x is not null and trim(x) <> '') texts
  from {src}),
scored as (select account_id, cast(round_even(risk_probability * 100, 0) as int) risk_score, risk_probability,
  case when risk_probability >= 0.5 then 'High' when risk_probability >= 0.35 then 'Medium' else 'Low' end risk_tier,
  risk_type,
  case when risk_type = 'General' then 'No dominant rule-based driver detected from available fields.'
       when len(texts) > 0 then array_to_string(list_slice(texts, 1, 3), ' | ')
       else 'Signals detected, but insufficient detail for explanation.' end drivers,
  {reco} recommendation,
  {context}
  from sc0),
disp as (select *, printf('%.1f%%', risk_probability * 100) risk_probability_pct,
  coalesce(trim(list_filter(string_split(coalesce(drivers, ''), '|'), lambda x: trim(x) <> '')[1]), '') primary_driver,
  recommendation primary_reco,
  case risk_tier when 'High' then 0 when 'Medium' then 1 when 'Low' then 2 else 9 end _tier_order,
  case risk_tier when 'High' then '🔴 High' when 'Medium' then '🟠 Medium' else '🟢 Low' end risk_badge
  from scored)"""


def oracle_queries_jkl() -> dict[str, str]:
    feat_dbl = FEATURE_DOUBLES
    q_all = QUARTERLY_CTES + ",\n" + EXPLAIN_SELF + ",\n" + _scored_sql()
    expl = "select account_id, usage_flag, usage_txt, support_flag, support_txt, sat_flag, sat_txt, comm_flag, comm_txt"
    hist_dbl = ["hist_usage_median", "hist_tickets_median", "hist_csat_median"]
    ctx_dbl = ["seats", "avg_csat", "hist_usage_median", "hist_tickets_median", "hist_csat_median",
               "days_to_contract_end", "auto_renew_flag"]
    health = " union all ".join(
        f"select '{c}' \"column\", count(distinct {c}) unique_values, stddev_samp(cast({c} as double)) std_dev from feats2"
        for c in ["usage_count_qoq_delta_z", "tickets_opened_qoq_delta_z", "usage_drop_flag",
                  "days_to_contract_end_capped", "arr_amount_qoq_delta_z", "seats_qoq_delta_z", "seats", "tenure",
                  "avg_satisfaction"])
    hist_sql = " union all ".join(f"""
select {b} bins, cast(i as int) bin, i / {float(b)} lo, (i + 1) / {float(b)} hi,
       (select count(*) from scored where risk_probability between 0 and 1
          and least(floor(risk_probability * {b}), {b - 1}) = i) n
from range({b}) t(i)""" for b in (18, 24))
    view = """
select account_id, risk_score, risk_probability_pct, risk_badge, risk_type, primary_driver, primary_reco,
       _tier_order, risk_probability, row_number() over (order by _tier_order, risk_probability desc, account_id) as position
from disp where risk_tier in ('High', 'Medium') and risk_probability >= 0.0"""
    return {
        "standardised_ingest": _q("select subscription_id, account_id, start_date, end_date, plan_tier, seats, "
                                  "arr_amount from subscriptions", ["arr_amount"]),
        "upload_single": _upload(single_builder("sfix", "s_"), "select * from s_f", feat_dbl),
        "upload_multi": _upload(MULTI_CTES, "select * from m_f", feat_dbl),
        "history_upsert": _upload("""
rev as (select * replace (ticket_count + 1 as ticket_count) from newq)""", """
select account_id, as_of_quarter, usage_count_total, ticket_count from hist
union all select account_id, as_of_quarter, usage_count_total, ticket_count from rev"""),
        "history_medians": _upload("""
meds0 as (select account_id, median(usage_count_total) hist_usage_median, median(ticket_count) hist_tickets_median,
                 median(avg_csat) hist_csat_median, cast(null as double) hist_resolution_median,
                 cast(null as double) hist_first_response_median from hist group by account_id)""",
                                   "select * from meds0", hist_dbl),
        "upload_quarterly": _upload(QUARTERLY_CTES, "select * from feats2",
                                    feat_dbl + ["avg_csat", "hist_usage_median", "hist_tickets_median",
                                                "hist_csat_median", "seats_enrich", "arr_amount", "mrr_amount",
                                                "avg_resolution_hours", "avg_first_response_minutes",
                                                "auto_renew_flag", "hist_resolution_median",
                                                "hist_first_response_median"]),
        "pct_rank": _upload(QUARTERLY_CTES, """
select account_id, v, ((rank() over (order by v) - 1) + (count(*) over (partition by v) + 1) / 2.0)
                      / count(*) over () pct_rank
from (select account_id, coalesce(usage_count_qoq_delta_z, 0.0) v from feats2)""", ["v", "pct_rank"]),
        "explain_self": _upload(QUARTERLY_CTES + ",\n" + EXPLAIN_SELF, expl + " from self_x"),
        "explain_peers": _upload(single_builder("sfix", "s_") + ",\n" + _peer_sql("s_f"), expl + " from peer_x"),
        "scored": _upload(q_all, "select * from scored", ["risk_probability"] + ctx_dbl),
        "coverage": _q("""
select (select count(*) from accounts) accounts, (select count(*) from subscriptions) subscriptions,
       (select count(distinct subscription_id) from feature_usage)
         / greatest(1, (select count(distinct subscription_id) from subscriptions)) usage_coverage_subs,
       (select count(distinct account_id) from support_tickets)
         / greatest(1, (select count(distinct account_id) from accounts)) ticket_coverage_accounts,
       '' missing_optional""", ["usage_coverage_subs", "ticket_coverage_accounts"]),
        "score_health": _upload(q_all, f"""
select h.*, (select count(distinct risk_probability) <= 3 or coalesce(stddev_samp(risk_probability), 0.0) < 1e-4
             from scored) degenerate
from (select 'risk_probability' "column", count(distinct risk_probability) unique_values,
             stddev_samp(risk_probability) std_dev from scored
      union all {health}) h""", ["std_dev"]),
        "kpis": _upload(q_all, """
select count(*) rows_scored, avg(risk_probability) avg_probability,
       count(*) filter (where risk_tier = 'High') high_risk, count(*) filter (where risk_tier = 'Medium') medium_risk
from scored""", ["avg_probability"]),
        "tier_counts": _upload(q_all, """
select t.risk_tier, t.tier_order, coalesce(c.n, 0) n
from (select 'High' risk_tier, 0 tier_order union all select 'Medium', 1 union all select 'Low', 2) t
left join (select risk_tier, count(*) n from scored group by 1) c using (risk_tier)"""),
        "prob_histogram": _upload(q_all, hist_sql, ["lo", "hi"]),
        "top_risk": _upload(q_all, """
select account_id, risk_badge, risk_probability_pct, risk_type, primary_driver, primary_reco
from disp order by _tier_order, risk_probability desc, account_id limit 20"""),
        "driver_counts": _upload(q_all, """
select driver, count(*) n from (
  select trim(unnest(string_split(drivers, '|'))) driver from scored
  where risk_tier in ('High', 'Medium') and drivers is not null) where driver <> ''
group by driver order by n desc, driver limit 12"""),
        "risk_view": _upload(q_all, view, ["risk_probability"]),
        "risk_view_head": _upload(q_all, f"select * from ({view}) where position <= 40", ["risk_probability"]),
        "upload_duplicate_keys": _upload("""
every_row as (select account_id, as_of_quarter from hist union all select account_id, as_of_quarter from newq
              union all select account_id, as_of_quarter from newq)""", """
select cast(sum(n - 1) as bigint) duplicate_rows from (select count(*) n from every_row group by account_id, as_of_quarter)"""),
    }


_hi_oracle = oracle_queries


def oracle_queries() -> dict[str, str]:  # noqa: F811
    out = _hi_oracle()
    out.update(oracle_queries_jkl())
    return out


# ------------------------------------------------------------------ observed labels and the fitted model

STORED = "fitted_sf0.01.json"


def stored_fits() -> tuple:
    """(model of the training quarters, {fold quarter: model}) as fitted at
    sf0.01, the scale of the correctness gate, by scripts/store_fits.py.  The
    oracle of ``fit_optimality`` proves on DuckDB's own features that they are
    the optimum; the other oracles then score with them."""
    import json
    import os

    from churnlens.operators.model import LinearSpec
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), STORED), encoding="utf-8") as f:
        d = json.load(f)
    read = lambda x: LinearSpec.from_json(json.dumps(x))
    return read(d["train"]), {q: read(x) for q, x in d["folds"].items()}


METRIC_CTES = """
, auc as (
  select case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (cum_neg - 0.5 * neg)) / (sum(pos) * sum(neg)) end validation_auc
  from (select p, sum(label) pos, sum(1 - label) neg,
               sum(sum(1 - label)) over (order by p rows between unbounded preceding and current row) cum_neg
        from vscored group by p)),
at_half as (
  select coalesce(count(*) filter (where p >= 0.5 and label = 1) / nullif(count(*) filter (where p >= 0.5), 0), 0.0) validation_precision_at_0_5,
         coalesce(count(*) filter (where p >= 0.5 and label = 1) / nullif(count(*) filter (where label = 1), 0), 0.0) validation_recall_at_0_5
  from vscored),
ordered as (select row_number() over w k, sum(label) over (w rows between unbounded preceding and current row) tp
            from vscored window w as (order by p desc, account_id, quarter)),
tot as (select count(*) n, sum(label) pp from vscored),
cuts as (select k, tp / k prec, case when pp > 0 then tp / pp else 0.0 end rec, n, pp from ordered, tot),
ranked_metrics as (
  select max(prec) filter (where k = ceil(n * 0.05)) precision_top5, max(rec) filter (where k = ceil(n * 0.05)) recall_top5,
         max(prec) filter (where k = ceil(n * 0.10)) precision_top10, max(rec) filter (where k = ceil(n * 0.20)) recall_top20,
         max(prec) filter (where k = ceil(n * 0.10)) / nullif(max(pp) / max(n), 0) lift_top10,
         max(prec) best_precision_at_k, arg_max(k, (prec, -k)) best_precision_k,
         max(rec) best_recall_at_k, arg_max(k, (rec, -k)) best_recall_k from cuts)
"""
METRIC_DOUBLES = ["validation_auc", "validation_precision_at_0_5", "validation_recall_at_0_5", "precision_top5", "recall_top5",
                  "precision_top10", "recall_top20", "lift_top10", "best_precision_at_k", "best_recall_at_k"]


def _folds_sql(scores: dict | None) -> str:
    """Expanding-window folds of the last five labelled quarters; ``scores``:
    model per fold quarter (None: the fixed scorer for all)."""
    label = "cast(qi // 4 as varchar) || 'Q' || cast(qi % 4 + 1 as varchar)"
    p = _prob_sql() if scores is None else "case " + " ".join(f"when {label} = '{q}' then {_prob_sql(s)}" for q, s in scores.items()) + " end"
    return f"""
, perq as (select qi, count(*) n, sum(churn_label_q1_rolling) pos from split group by qi),
foldq as (select *, coalesce(sum(n) over before, 0) n_train, coalesce(sum(pos) over before, 0) pos_train from perq
          window before as (order by qi rows between unbounded preceding and 1 preceding)
          qualify row_number() over (order by qi desc) <= 5),
fscored as (select qi, cast(churn_label_q1_rolling as int) label, {p} p from split where qi in (select qi from foldq)),
fauc as (select qi, sum(pos * (cum_neg - 0.5 * neg)) / (sum(pos) * sum(neg)) auc
         from (select qi, p, sum(label) pos, sum(1 - label) neg,
                      sum(sum(1 - label)) over (partition by qi order by p rows between unbounded preceding and current row) cum_neg
               from fscored group by qi, p) group by qi having sum(pos) > 0 and sum(neg) > 0),
folds as (select {label} fold_quarter, cast(n_train as bigint) n_train, cast(pos_train as bigint) pos_train, n n_valid,
                 cast(pos as bigint) pos_valid,
                 not (pos_train > 0 and pos_train < n_train and pos > 0 and pos < n) skipped,
                 case when pos_train > 0 and pos_train < n_train and pos > 0 and pos < n then auc end auc
          from foldq left join fauc using (qi))
"""


def _preprocessor_sql() -> str:
    from churnlens.operators.features import BINARY, CATEGORICAL, CONTINUOUS
    rows = []
    for i, c in enumerate(CONTINUOUS):
        med = f"(select coalesce(median(cast({c} as double)), 0.0) from train)"
        rows.append(f"select {i} position, 'num__{c}' term, '{c}' base_feature, 'num' kind, cast(null as varchar) impute_level, {med} impute_value, "
                    f"avg(coalesce(cast({c} as double), {med})) mean, "
                    f"case when stddev_pop(coalesce(cast({c} as double), {med})) > 0 then stddev_pop(coalesce(cast({c} as double), {med})) "
                    f"else 1.0 end scale, cast(null as varchar) as \"level\" from train")
    mode = lambda c: (f"(select cast({c} as varchar) from train where {c} is not null group by 1 "  # noqa: E731
                      f"order by count(*) desc, 1 limit 1)")
    for i, c in enumerate(BINARY, len(CONTINUOUS)):
        rows.append(f"select {i}, 'bin__{c}', '{c}', 'bin', null, cast({mode(c)} as double), 0.0, 1.0, null")
    c, n = CATEGORICAL[0], len(CONTINUOUS) + len(BINARY)
    rows.append(f"select cast({n} + row_number() over (order by v) - 2 as int), 'cat__{c}_' || v, '{c}', 'cat', {mode(c)}, null, 0.0, 1.0, v "
                f"from (select distinct {c} v from train) qualify row_number() over (order by v) > 1")
    return ", train as (select * from split where split = 'train')\n" + "\nunion all ".join(rows)


def _optimality_sql(spec) -> str:
    """Residuals of the elastic-net optimality conditions at the stored
    coefficients, each from its own sum over the training rows."""
    c_, a = 0.05, 0.2  # the documented objective: C and the l1 share; weights {0: 1, 1: 2}
    cols = ", ".join(f"{_transformed_sql(t)} x{i}" for i, t in enumerate(spec.terms))
    rows = [f"select '(intercept)' term, {spec.intercept!r} b, sum(pull) / sum(w) g, sum(w) tw, true free from pulled"]
    rows += [f"select '{t.name}', {t.coef!r}, sum(pull * x{i}) / sum(w), sum(w), false from pulled" for i, t in enumerate(spec.terms)]
    return f"""
, pulled as (select *, w * (p - y) pull from (
    select cast(churn_label_q1_rolling as double) y, case when churn_label_q1_rolling = 1 then 2.0 else 1.0 end w, {_prob_sql(spec)} p, {cols}
    from split where split = 'train')),
sums as ({" union all ".join(rows)}),
off as (select term, b, case when free then abs(g)
               when b <> 0 then abs(g + (1 - {a}) * b / ({c_} * tw) + {a} * sign(b) / ({c_} * tw))
               else greatest(abs(g) - {a} / ({c_} * tw), 0.0) end residual from sums)
select term, b coefficient, residual, residual <= 1e-9 optimal from off"""


def oracle_queries_fitted() -> dict[str, str]:
    spec, folds = stored_fits()
    thresholds = "[0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]"
    peers = "plan_tier, seats, as_of_date, signup_date, quarter_end, signup_date_inferred_flag, as_of_date_inferred_flag"
    coefs = " union all ".join(f"select '{t.name}' feature, {t.coef!r} coefficient, '{t.base}' base" for t in spec.terms)
    table = f"""select row_number() over (order by round(abs(coefficient), 9) desc, feature) as position, feature, coefficient,
  abs(coefficient) abs_coefficient, regexp_extract(feature, '^[^_]*?__(.*)$', 1) base_feature, exp(coefficient) odds_ratio,
  case when coefficient >= 0 then 'Increase churn risk' else 'Decrease churn risk' end interpretation from ({coefs})"""
    return {
        "source_horizons": _q("""select source, n_dates, first_date, last_date,
       cast(from_idx // 4 as varchar) || 'Q' || cast(from_idx % 4 + 1 as varchar) observed_from,
       cast(until_idx // 4 as varchar) || 'Q' || cast(until_idx % 4 + 1 as varchar) observed_until from horizons""",
                              extra=[("horizons", HORIZONS)]),
        "observed_label_availability": rounded(ctes(*panel_ctes("quarter", True)) + """
select quarter, count(*) n_rows, bool_and(label_available_q1) label_available_q1,
       bool_and(label_available_q2) label_available_q2,
       count(churn_label_q1_rolling) n_label_q1, cast(sum(churn_label_q1_rolling) as bigint) sum_label_q1,
       count(churn_label_q2_rolling) n_label_q2, cast(sum(churn_label_q2_rolling) as bigint) sum_label_q2
from panel_quarter group by quarter""", []),
        "observed_time_split": _eval("""
select cast(qi // 4 as varchar) || 'Q' || cast(qi % 4 + 1 as varchar) as quarter, split, count(*) n_rows,
       cast(sum(churn_label_q1_rolling) as bigint) n_pos from split group by all""", observed=True),
        "observed_validation_report": _eval("""
select count(*) filter (where split = 'valid') validation_sample_count,
       avg(cast(churn_label_q1_rolling as double)) filter (where split = 'valid') validation_positive_rate,
       avg(1 - cast(churn_label_q1_rolling as double)) filter (where split = 'valid') validation_negative_rate,
       (select string_agg(q, ',' order by q) from (select distinct cast(qi // 4 as varchar) || 'Q' ||
               cast(qi % 4 + 1 as varchar) q from split where split = 'train')) train_quarters,
       (select string_agg(q, ',' order by q) from (select distinct cast(qi // 4 as varchar) || 'Q' ||
               cast(qi % 4 + 1 as varchar) q from split where split = 'valid')) valid_quarters,
       count(*) filter (where split = 'train') n_train, count(*) filter (where split = 'valid') n_valid
from split""", ["validation_positive_rate", "validation_negative_rate"], observed=True),
        "observed_metrics": _eval(METRIC_CTES + "select * from auc, at_half, ranked_metrics", METRIC_DOUBLES, observed=True),
        "observed_threshold_curve": _eval(f"""
select cast(t as double) threshold, coalesce(count(*) filter (where p >= t and label = 1) / nullif(count(*) filter (where p >= t), 0), 0.0) "precision",
       coalesce(count(*) filter (where p >= t and label = 1) / nullif(count(*) filter (where label = 1), 0), 0.0) recall,
       count(*) filter (where p >= t) n_flagged
from vscored, (select unnest({thresholds}) t) group by t""", ["threshold", '"precision"', "recall"], observed=True),
        "observed_folds": _eval(_folds_sql(None) + "select * from folds", ["auc"], observed=True),
        "preprocessor_table": _eval(_preprocessor_sql(), ["impute_value", "mean", "scale"], observed=True),
        "trained_scores": _eval("select account_id, quarter, label, round(p, 5) p from vscored", observed=True, spec=spec),
        "fit_optimality": _eval(_optimality_sql(spec), ["coefficient", "residual"], observed=True),
        "trained_metrics": _eval(METRIC_CTES + "select *, 0.05 best_c, '{0: 1, 1: 2}' class_weight, 'elasticnet' penalty, 0.2 l1_ratio "
                                 "from auc, at_half, ranked_metrics", METRIC_DOUBLES + ["best_c", "l1_ratio"], observed=True, spec=spec),
        "coefficient_table": rounded(table, ["coefficient", "abs_coefficient", "odds_ratio"]),
        "driver_strength": rounded(f"select base_feature, sum(abs_coefficient) abs_coefficient from ({table}) group by 1", ["abs_coefficient"]),
        "cv_folds": _eval(_folds_sql(folds) + "select * from folds", ["auc"], observed=True),
        "cv_summary": _eval(_folds_sql(folds) + """
select cast(count(*) filter (where not skipped) as int) ts_cv_folds, cast(count(*) filter (where skipped) as int) ts_cv_skipped_folds,
       avg(auc) ts_cv_auc_mean, min(auc) ts_cv_auc_min, max(auc) ts_cv_auc_max, stddev_pop(auc) ts_cv_auc_std,
       0.05 best_c, '{0: 1, 1: 2}' class_weight, 'elasticnet' penalty, 0.2 l1_ratio from folds""",
                            ["ts_cv_auc_mean", "ts_cv_auc_min", "ts_cv_auc_max", "ts_cv_auc_std", "best_c", "l1_ratio"], observed=True),
        "score_job_single": _upload(single_builder("sfix", "s_") + ",\n" + _peer_sql("s_f") + ",\n" + _scored_sql("peer_x", peers),
                                    "select * from scored", ["risk_probability", "seats"]),
        "score_job_multi": _upload(MULTI_CTES + ",\n" + _peer_sql("m_f") + ",\n" + _scored_sql("peer_x", peers),
                                   "select * from scored", ["risk_probability", "seats"]),
        "staged_latest_snapshot": oracle_queries_panel()["latest_snapshot_quarter"],
        "score_job_quarterly": rounded("select * replace (" + ", ".join(
            f"cast({c} as double) as {c}" for c in ["usage_count_total", "ticket_count", "days_to_contract_end", "escalation_count"])
            + ") from (" + oracle_queries_jkl()["scored"] + ") s0", []),
        "ingest_rows": _q("""
select subscription_id, account_id, case when k % 11 <> 0 then start_date end start_date, case when k % 13 <> 0 then end_date end end_date,
       plan_tier, case when k % 7 <> 0 then seats end seats, case when k % 23 <> 0 then arr_amount end arr_amount,
       case when k % 29 <> 0 then auto_renew_flag end auto_renew_flag
from (select *, cast(subscription_id as bigint) k from subscriptions) where k % 17 <> 0 and k % 19 <> 0""", ["arr_amount"]),
        "ingest_rejects": _q("""
select 'subscriptions' as "table", c as "column", 'bad value' reason, (select count(*) from subscriptions where cast(subscription_id as bigint) % m = 0) n
from (values ('start_date', 11), ('end_date', 13), ('seats', 7), ('arr_amount', 23), ('auto_renew_flag', 29)) t(c, m)
union all
select 'subscriptions', c, 'missing id', (select count(*) from subscriptions where cast(subscription_id as bigint) % m = 0)
from (values ('account_id', 17), ('subscription_id', 19)) t(c, m)"""),
        "stored_model_risk": _eval(_risk_body(spec) + "select * from risk", RISK_DOUBLES, observed=True),
    }


_jkl_oracle = oracle_queries


def oracle_queries() -> dict[str, str]:  # noqa: F811
    out = _jkl_oracle()
    out.update(oracle_queries_fitted())
    return out
