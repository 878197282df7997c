"""Event-order queries: admissions, budgets, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitgrid.bindings import AS_OF, Domain, abuse_rows, ntz
from fitgrid.operators import admission, consent
from fitgrid.plans.registry import query
from fitgrid.plans.twins import twin
from fitgrid.streaming import keyed, runs, windows

DAY = 86_400

_SINGLE = """
    with recursive r as (select event_id % 40 as url_id, event_id, ts, row_number() over (partition by event_id % 40 order by ts, event_id) as n
      from events where event_type in ('click', 'view')),
    f as (select url_id, n, event_id, ts as last_start, true as ok from r where n = 1
      union all select r.url_id, r.n, r.event_id, case when f.last_start < r.ts - interval 6 hour then r.ts else f.last_start end,
        f.last_start < r.ts - interval 6 hour from f join r on r.url_id = f.url_id and r.n = f.n + 1)
    select url_id, event_id, case when ok then 'started' else 'joined' end as outcome from f"""


@query("singleflight", _SINGLE)
def singleflight(d: Domain):
    return admission.single_flight(d.requests, "url_id", 6 * 3600)


_ALLOWANCE = """
    with recursive r as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n
      from events where event_type in ('click', 'view')),
    f as (select user_id, n, event_id, [ts] as taken, true as ok from r where n = 1
      union all select r.user_id, r.n, r.event_id,
        case when len(list_filter(f.taken, lambda x: x >= r.ts - interval 1 day)) < 2 then list_append(f.taken, r.ts) else f.taken end,
        len(list_filter(f.taken, lambda x: x >= r.ts - interval 1 day)) < 2
      from f join r on r.user_id = f.user_id and r.n = f.n + 1)
    select user_id, event_id, case when ok then 'admitted' else 'rejected' end as decision from f"""


@query("request_allowance", _ALLOWANCE)
def request_allowance(d: Domain):
    return admission.rolling_admissions(d.requests, "user_id", 2, DAY)


@query("request_allowance_by_slices", _ALLOWANCE)
def request_allowance_by_slices(d: Domain):
    """The same allowance over requests that are spread over many partitions first."""
    return admission.rolling_admissions(d.requests.repartition(64), "user_id", 2, DAY)


_QUOTA = """
    with recursive r as (select user_id, event_id, ts, event_id % 7 as item, row_number() over (partition by user_id order by ts, event_id) as n
      from events where event_type = 'click'),
    f as (select user_id, n, event_id, [{'t': ts, 'u': item}] as taken, 'admitted' as decision from r where n = 1
      union all select user_id, n, event_id, case when decision = 'admitted' then list_append(taken, {'t': ts, 'u': item}) else taken end, decision from (
        select r.user_id, r.n, r.event_id, r.ts, r.item, f.taken,
          case when len(list_filter(f.taken, lambda x: x.t >= r.ts - interval 5 day and x.u = r.item)) > 0 then 'repeat'
            when len(list_filter(f.taken, lambda x: x.t >= r.ts - interval 5 day)) < 3 then 'admitted' else 'rejected' end as decision
        from f join r on r.user_id = f.user_id and r.n = f.n + 1) z)
    select user_id, event_id, decision from f"""


def new_analyses(d: Domain):
    return d.events.where("event_type = 'click'").select(
        "event_id", "user_id", "ts", (F.col("event_id") % 7).alias("url_id"))


@query("new_analysis_quota", _QUOTA)
def new_analysis_quota(d: Domain):
    return admission.rolling_admissions(new_analyses(d), "user_id", 3, 5 * DAY, item="url_id")


@query("new_analysis_quota_by_slices", _QUOTA)
def new_analysis_quota_by_slices(d: Domain):
    """The same quota over requests that are spread over many partitions first."""
    return admission.rolling_admissions(new_analyses(d).repartition(64), "user_id", 3, 5 * DAY, item="url_id")


_DISCOVERY = """
    with recursive r as (select user_id, event_id, event_id % 23 as q, ts, row_number() over (order by ts, event_id) as n
      from events where event_type in ('signup', 'purchase')),
    f as (select n, event_id, user_id, q, [{'t': ts, 'u': user_id, 'q': q}] as s, 'started' as decision from r where n = 1
      union all select n, event_id, user_id, q, case when decision = 'started' then list_append(list_filter(s, lambda x: x.t >= ts - interval 10 day), {'t': ts, 'u': user_id, 'q': q}) else s end, decision from (
        select r.*, f.s, case when len(list_filter(f.s, lambda x: x.q = r.q and x.t > r.ts - interval 3 day)) > 0 then 'joined'
          when len(list_filter(f.s, lambda x: x.q = r.q and x.t >= r.ts - interval 5 day)) > 0 then 'reused'
          when len(list_filter(f.s, lambda x: x.u = r.user_id and x.t >= r.ts - interval 9 day)) >= 1 then 'rate_limited'
          when len(list_filter(f.s, lambda x: x.t > r.ts - interval 3 day)) >= 8 then 'busy' else 'started' end as decision
        from f join r on r.n = f.n + 1) z)
    select event_id, user_id, q as query_key, decision from f"""


@query("resolver_limits", _DISCOVERY)
def resolver_limits(d: Domain):
    asked = d.events.where("event_type in ('signup', 'purchase')").select(
        "event_id", "user_id", "ts", (F.col("event_id") % 23).alias("query_key"))
    return admission.discovery_decisions(
        asked, active_seconds=3 * DAY, fresh_seconds=2 * DAY, user_limit=1, user_seconds=9 * DAY, cap=8)


_BUDGET = """
    with recursive r as (select cast(ts as date) as usage_date, event_id, 1 + event_id % 7 as units,
        row_number() over (partition by cast(ts as date) order by ts, event_id) as n from events),
    f as (select usage_date, n, event_id, units, units as total, true as reserved from r where n = 1
      union all select r.usage_date, r.n, r.event_id, r.units, case when f.total + r.units <= 1000 then f.total + r.units else f.total end,
        f.total + r.units <= 1000 from f join r on r.usage_date = f.usage_date and r.n = f.n + 1)"""


@query("daily_budget", _BUDGET + " select usage_date, event_id, units, reserved from f")
def daily_budget(d: Domain):
    return admission.budget_reservations(d.reservations, 1000)


@query("external_cost_daily", _BUDGET + " select usage_date as day, sum(units)::bigint as reserved_units from f where reserved group by 1")
def external_cost_daily(d: Domain):
    return admission.daily_cost(admission.budget_reservations(d.reservations, 1000))


# Streams -------------------------------------------------------------------------------------

def stream(d: Domain):
    return runs.event_stream(d.spark, d.directory)


def instant(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("request_allowance_stream", _ALLOWANCE)
def request_allowance_stream(d: Domain):
    asked = stream(d).where("event_type in ('click', 'view')")
    return runs.run_to_table(keyed.admission_stream(asked, "user_id", 2, DAY), "allowance")


@query("new_analysis_quota_stream", _QUOTA)
def new_analysis_quota_stream(d: Domain):
    asked = stream(d).where("event_type = 'click'").withColumn("url_id", F.col("event_id") % 7)
    return runs.run_to_table(keyed.admission_stream(asked, "user_id", 3, 5 * DAY, "url_id"), "quota")


@query("singleflight_stream", _SINGLE)
def singleflight_stream(d: Domain):
    asked = stream(d).where("event_type in ('click', 'view')").withColumn("url_id", F.col("event_id") % 40)
    decided = runs.run_to_table(keyed.admission_stream(asked, "url_id", 1, 6 * 3600), "flight")
    return decided.select("url_id", "event_id", F.when(
        F.col("decision") == "admitted", "started").otherwise("joined").alias("outcome"))


@query("daily_budget_stream", _BUDGET + " select usage_date, event_id, reserved from f")
def daily_budget_stream(d: Domain):
    rows = stream(d).withColumn("units", 1 + F.col("event_id") % 7)
    return runs.run_to_table(keyed.budget_stream(rows, 1000), "budget")


def http_stream(d: Domain):
    kind = F.col("event_type")
    return stream(d).select(
        "ts", kind.alias("route"),
        F.when((kind == "error") & (F.col("value") > 15), 500).otherwise(200).alias("status"),
        F.round(F.col("value") * 10).cast("bigint").alias("duration_ms"))


@query("windowed_metrics", twin("""
    select date_trunc('hour', ts) as window_start, route, count(*) as requests, count(*) filter (where status >= 500) as errors,
      sum(duration_ms)::bigint as duration_ms from http_requests
    where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 10 minute from events) group by 1, 2"""))
def windowed_metrics(d: Domain):
    """Windows the watermark has closed; the last ones stay in state until later events arrive."""
    table = runs.run_to_table(windows.windowed_metrics(http_stream(d)), "metrics")
    return table.withColumn("window_start", instant("window_start"))


@query("sliding_metrics", twin("""
    select w.s as window_start, route, count(*) as requests, count(*) filter (where status >= 500) as errors, sum(duration_ms)::bigint as duration_ms
    from http_requests join (select unnest(generate_series(timestamp '2023-12-31 23:00:00', timestamp '2024-01-31', interval 30 minute)) as s) w
      on ts >= w.s and ts < w.s + interval 1 hour
    where w.s + interval 1 hour <= (select max(ts) - interval 10 minute from events) group by 1, 2"""))
def sliding_metrics(d: Domain):
    table = runs.run_to_table(windows.windowed_metrics(http_stream(d), "1 hour", "30 minutes"), "sliding")
    return table.withColumn("window_start", instant("window_start"))


@query("abuse_stream", twin("""
    select d.day, a.event_type, count(*) as events, count(distinct a.user_id) as users, coalesce(max(w.n), 0) as max_users_per_ip_key
    from (select distinct cast(ts as date) as day from events) d
    join abuse_events a on cast(a.ts as date) between d.day - 6 and d.day
    left join widest w on w.day = d.day and w.event_type = a.event_type group by 1, 2""", """widest as (
      select day, event_type, max(n) as n from (
        select d.day, a.event_type, a.ip_key, count(distinct a.user_id) as n
        from (select distinct cast(ts as date) as day from events) d
        join abuse_events a on cast(a.ts as date) between d.day - 6 and d.day where a.ip_key is not null group by 1, 2, 3) z group by 1, 2)"""))
def abuse_stream(d: Domain):
    rows = abuse_rows(stream(d)).select("ts", "event_type", "ip_key", "user_id")
    return windows.abuse_days(runs.run_to_table(windows.abuse_pairs(rows), "abuse", mode="update"))


@query("consent_stream", twin("select purpose, user_id from consented_users"))
def consent_stream(d: Domain):
    ts, kind = F.col("ts"), F.col("event_type")
    decisions = stream(d).where("event_type in ('signup', 'error')").select(
        "ts", "event_id", "user_id", F.lit("community_benchmark").alias("purpose"),
        F.when(ts < F.lit("2024-01-15").cast("timestamp"), 1).otherwise(2).cast("bigint").alias("policy_id"),
        F.when(kind == "signup", "granted").otherwise("withdrawn").alias("action"))
    updates = runs.run_to_table(windows.latest_decisions(decisions), "consent", mode="update")
    return windows.live_consent(updates, consent.current_policies(d.consent_policies, ntz(AS_OF)))


@query("lease_expiry", """
    with recursive c as (select event_id % 97 as job_id, epoch_us(ts) // 1000 as ms, case when event_type = 'purchase' then 0 else 3600 * (1 + event_id % 4) end as lease,
        row_number() over (partition by event_id % 97 order by ts, event_id) as n from events),
    f as (select job_id, n, case when lease > 0 then ms + lease * 1000 else 0 end as until_ms, case when lease > 0 then 1 else 0 end as attempts,
        0::bigint as expired_at, 0 as expired_attempts, 0::bigint as completed_at, 0 as completed_attempts from c where n = 1
      union all select job_id, n, case when lease > 0 then ms + lease * 1000 else 0 end,
        case when lease = 0 then 0 when until_ms > 0 and ms <= until_ms then attempts else attempts + 1 end,
        case when until_ms > 0 and ms > until_ms then until_ms else 0 end, attempts,
        case when lease = 0 and until_ms > 0 and ms <= until_ms then ms else 0 end, attempts
      from (select c.*, f.until_ms, f.attempts from f join c on c.job_id = f.job_id and c.n = f.n + 1) z),
    last_rows as (select * from (select *, row_number() over (partition by job_id order by n desc) as r from f) z where r = 1)
    select job_id, make_timestamp(expired_at * 1000) as at, case when expired_attempts >= 3 then 'failed' else 'requeued' end as outcome, expired_attempts as attempts from f where expired_at > 0
    union all select job_id, make_timestamp(completed_at * 1000), 'completed', completed_attempts from f where completed_at > 0
    union all select job_id, make_timestamp(until_ms * 1000), case when attempts >= 3 then 'failed' else 'requeued' end, attempts from last_rows
      where until_ms > 0 and until_ms <= (select epoch_us(max(ts)) // 1000 - 600000 from events)""")
def lease_expiry(d: Domain):
    changes = stream(d).select(
        (F.col("event_id") % 97).alias("job_id"), "event_id", "ts",
        F.when(F.col("event_type") == "purchase", 0).otherwise(3600 * (1 + F.col("event_id") % 4)).alias("lease_seconds"))
    return runs.run_to_table(keyed.lease_stream(changes, max_attempts=3), "leases").select(
        "job_id", instant("at"), "outcome", "attempts")
