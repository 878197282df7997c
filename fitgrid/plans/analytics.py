"""Analytics, consent and operations queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitgrid.bindings import AS_OF, Domain, ntz
from fitgrid.operators import analytics, consent, metrics
from fitgrid.plans.registry import query
from fitgrid.plans.twins import twin


def now():
    return ntz(AS_OF)


def consented(d: Domain):
    return consent.consented_users(d.consent_events, d.consent_policies, now())


TOKYO = "cast({} + interval 9 hours as date)"


@query("daily_active_users", """
    select cast(ts + interval 9 hours as date) as day, count(distinct user_id) as active_users
    from events where event_type in ('click', 'view') group by 1""")
def daily_active_users(d: Domain):
    def of(kind):
        return d.events.where(F.col("event_type") == kind).select("user_id", F.col("ts").alias("at"))
    return analytics.daily_active_users(of("click"), of("view"))


@query("analysis_usage_daily", """
    select cast(ts + interval 9 hours as date) as day, count(*) as new_analyses, count(distinct user_id) as users
    from events where event_type = 'click' group by 1""")
def analysis_usage_daily(d: Domain):
    return analytics.usage_daily(d.events.where("event_type = 'click'"))


@query("consent_rate", twin("""
    select c.purpose, c.version, count(u.user_id) as consented_users, (select count(*) from customer) as total_users,
      (count(u.user_id) * 100 * 20 + (select count(*) from customer)) // (2 * (select count(*) from customer)) / 10.0::double as consent_percent
    from current_policies c left join consented_users u on u.purpose = c.purpose group by 1, 2"""))
def consent_rate(d: Domain):
    return consent.consent_rate(consented(d), d.consent_policies, d.users, now())


@query("unknown_rate_daily", twin("""
    select cast(created_at + interval 9 hours as date) as day, axis_key, count(*) as evaluated,
      count(*) filter (where observation_status in ('unknown', 'conflicting')) as "unknown",
      (count(*) filter (where observation_status in ('unknown', 'conflicting')) * 2000 + count(*)) // (2 * count(*)) / 10.0::double as unknown_percent
    from evaluations join evaluated_axis_values using (evaluation_id) group by 1, 2"""))
def unknown_rate_daily(d: Domain):
    return analytics.unknown_rate_daily(d.evaluations, d.evaluated_axis_values)


@query("unknown_ratio", twin("""
    select strftime(created_at, '%Y-%m') as month, count(*) filter (where observation_status = 'unknown') as unknown_axes,
      count(*) as all_axes, count(*) filter (where observation_status = 'unknown')::double / count(*) as unknown_share
    from evaluations join evaluated_axis_values using (evaluation_id)
    where created_at >= timestamp '1996-01-01' and created_at < timestamp '1999-01-01' group by 1"""))
def unknown_ratio(d: Domain):
    return analytics.unknown_ratio(
        d.evaluations, d.evaluated_axis_values, ntz("1996-01-01"), ntz("1999-01-01"))


@query("evaluator_usage_daily", twin("""
    select cast(created_at + interval 9 hours as date) as day, evaluator_version, count(*) as evaluations
    from evaluations group by 1, 2"""))
def evaluator_usage_daily(d: Domain):
    return analytics.evaluator_usage_daily(d.evaluations)


@query("company_interest_daily", twin("""
    select cast(e.ts + interval 9 hours as date) as day, c.company_name, count(distinct e.user_id) as users
    from events e join consented_users u on u.user_id = e.user_id and u.purpose = 'community_benchmark'
    join companies c on c.company_id = e.event_id % 3 where e.event_type = 'view'
    group by 1, 2 having count(distinct e.user_id) >= 10"""))
def company_interest_daily(d: Domain):
    return analytics.company_interest_daily(d.company_interest, consented(d), d.companies)


@query("cohort_axis_distribution", twin("""
    select graduation_year, p.axis_catalog_version, axis_key, count(*) as users,
      (sum(preference) * 20 + count(*)) // (2 * count(*)) / 10.0::double as avg_preference,
      (sum(importance) * 20 + count(*)) // (2 * count(*)) / 10.0::double as avg_importance
    from (select user_id, max(year(ended_on)) as graduation_year from educations group by 1) y
    join consented_users u using (user_id)
    join (select *, row_number() over (partition by user_id order by version desc) as r
      from profile_versions where status = 'completed') p using (user_id)
    join profile_axis_values using (profile_version_id)
    where r = 1 and u.purpose = 'community_benchmark' group by 1, 2, 3 having count(*) >= 10"""))
def cohort_axis_distribution(d: Domain):
    return analytics.cohort_axis_distribution(
        consented(d), d.educations, d.profile_versions, d.profile_axis_values)


SINCE = "2024-01-10 00:00:00"


@query("abuse_overview", twin(f"""
    select event_type, count(*) as events, count(distinct user_id) as users,
      coalesce((select max(n) from (select event_type as k, ip_key, count(distinct user_id) as n from abuse_events
        where ts >= timestamp '{SINCE}' and ip_key is not null group by 1, 2) s where s.k = a.event_type), 0) as max_users_per_ip_key
    from abuse_events a where ts >= timestamp '{SINCE}' group by 1"""))
def abuse_overview(d: Domain):
    return analytics.abuse_overview(d.abuse_events, ntz(SINCE))


@query("abuse_user_summary", twin(f"""
    select user_id, count(*) filter (where event_type = 'analysis_new') as new_analyses,
      count(*) filter (where event_type = 'analysis_cached') as cached_requests,
      count(*) filter (where event_type = 'analysis_quota_rejected') as quota_rejections,
      count(*) filter (where event_type = 'analysis_rate_limited') as rate_limited,
      count(*) filter (where event_type = 'career_profile_saved') as profile_saves,
      count(*) filter (where event_type = 'share_created') as shares_created,
      coalesce(max(failed), 0) as failed_jobs, count(distinct a.ip_key) as distinct_ip_keys,
      count(distinct ua_key) as distinct_ua_keys, coalesce(max(k.n), 0) as max_users_sharing_ip_key
    from abuse_events a
    left join (select ip_key, count(distinct user_id) as n from abuse_events
      where ts >= timestamp '{SINCE}' group by 1) k on k.ip_key = a.ip_key
    left join (select user_id as u, count(*) as failed from analysis_jobs where attempts = 4 group by 1) f on f.u = a.user_id
    where ts >= timestamp '{SINCE}' group by 1
    order by max_users_sharing_ip_key desc, rate_limited + quota_rejections desc, new_analyses desc, user_id"""))
def abuse_user_summary(d: Domain):
    failed = d.analysis_jobs.where("attempts = 4").select("user_id")
    return analytics.abuse_users(d.abuse_events, failed, ntz(SINCE))


@query("job_backlog", twin("select * from backlog"))
def job_backlog(d: Domain):
    return analytics.job_backlog(d.job_runs)


@query("job_lifecycle_sweep", twin("""
    select status, case when status = 'running' and lease_until <= timestamp '1997-06-01' then
        case when attempts >= 3 then 'failed' else 'queued' end
      when status = 'queued' and attempts >= 3 then 'failed' else status end as next_status, count(*) as jobs
    from analysis_jobs group by 1, 2"""))
def job_lifecycle_sweep(d: Domain):
    return analytics.job_transitions(d.analysis_jobs, ntz("1997-06-01"), 3)


# Consent and legal ---------------------------------------------------------------------------

@query("current_policies", twin("""
    select c.purpose, c.policy_id, c.version, c.effective_at, count(e.event_id) as decisions
    from current_policies c left join consent_events e on e.purpose = c.purpose and e.policy_id = c.policy_id
    group by 1, 2, 3, 4"""))
def current_policies(d: Domain):
    """The policies in effect with the number of decisions taken under each."""
    decided = d.consent_events.groupBy("purpose", "policy_id").agg(F.count("*").alias("n"))
    return consent.current_policies(d.consent_policies, now()).join(
        decided, ["purpose", "policy_id"], "left"
    ).select("purpose", "policy_id", "version", "effective_at", F.coalesce("n", F.lit(0)).alias("decisions"))


@query("consented_users", twin("select purpose, user_id from consented_users"))
def consented_users(d: Domain):
    return consented(d)


@query("consent_status", twin("""
    select c.c_custkey as user_id, p.purpose, p.version,
      coalesce(l.action = 'granted' and l.policy_id = p.policy_id, false) as granted, l.recorded_at
    from customer c cross join current_policies p
    left join (select *, row_number() over (partition by purpose, user_id order by recorded_at desc, event_id desc) as r
      from consent_events where recorded_at <= timestamp '2024-01-31') l
      on l.r = 1 and l.purpose = p.purpose and l.user_id = c.c_custkey"""))
def consent_status(d: Domain):
    return consent.consent_status(d.users, d.consent_events, d.consent_policies, now())


@query("consent_history_compaction", twin("""
    select event_id, user_id, purpose, policy_id, action, recorded_at from (select *,
        lag(action) over w as pa, lag(policy_id) over w as pp from consent_events
        window w as (partition by purpose, user_id order by recorded_at, event_id)) z
    where case when action = 'granted' then not coalesce(pa = 'granted' and pp = policy_id, false)
      else coalesce(pa = 'granted', false) end"""))
def consent_history_compaction(d: Domain):
    return consent.consent_changes(d.consent_events)


def legal_documents(d: Domain):
    key = F.col("n_nationkey")
    start = F.lit("2023-12-01").cast("timestamp_ntz")
    return d.raw("nation").select(
        key.cast("bigint").alias("document_id"),
        F.when(key % 3 == 0, "terms").when(key % 3 == 1, "privacy").otherwise("guidelines")
        .alias("document_type"),
        (start + F.make_dt_interval(key * 3)).alias("published_at"),
        (start + F.make_dt_interval(key * 3 + key % 5)).alias("effective_at"))


def acknowledgements(d: Domain):
    return d.events.where("event_type in ('signup', 'purchase', 'error')").select(
        "event_id", "user_id", (F.col("event_id") % 25).alias("document_id"),
        F.when(F.col("event_type") == "signup", "accepted").otherwise("acknowledged").alias("action"),
        F.col("ts").alias("recorded_at"))


LEGAL = """legal_documents as (select n_nationkey as document_id,
      case n_nationkey % 3 when 0 then 'terms' when 1 then 'privacy' else 'guidelines' end as document_type,
      timestamp '2023-12-01' + to_days(n_nationkey * 3) as published_at,
      timestamp '2023-12-01' + to_days(n_nationkey * 3 + n_nationkey % 5) as effective_at from nation),
    acks as (select event_id, user_id, event_id % 25 as document_id,
      case when event_type = 'signup' then 'accepted' else 'acknowledged' end as action, ts as recorded_at
      from events where event_type in ('signup', 'purchase', 'error')),
    current_documents as (select * from (select *, row_number() over (partition by document_type
        order by effective_at desc, document_id desc) as r from legal_documents
      where published_at <= timestamp '2024-01-31' and effective_at <= timestamp '2024-01-31') z where r = 1)"""


@query("current_legal_documents", twin(
    """select document_type, document_id, effective_at, count(a.event_id) as acknowledgements
    from current_documents left join acks a using (document_id) group by 1, 2, 3""", extra=LEGAL))
def current_legal_documents(d: Domain):
    """The documents in effect with the acknowledgements recorded for each."""
    n = acknowledgements(d).groupBy("document_id").agg(F.count("*").alias("n"))
    return consent.current_documents(legal_documents(d), now()).join(n, "document_id", "left").select(
        "document_type", "document_id", "effective_at",
        F.coalesce("n", F.lit(0)).alias("acknowledgements"))


@query("legal_status", twin("""
    select c.c_custkey as user_id, k.document_type, k.document_id, min(a.recorded_at) as acted_at
    from customer c cross join current_documents k left join acks a on a.user_id = c.c_custkey
      and a.document_id = k.document_id and a.recorded_at <= timestamp '2024-01-31'
      and a.action = case when k.document_type = 'terms' then 'accepted' else 'acknowledged' end
    group by 1, 2, 3""", extra=LEGAL))
def legal_status(d: Domain):
    return consent.legal_status(d.users, legal_documents(d), acknowledgements(d), now())


@query("legal_history", twin("""
    select user_id, position, document_id, document_type, action, recorded_at from (
      select *, row_number() over (partition by user_id order by recorded_at desc, event_id desc) as position from acks) z
    join legal_documents using (document_id) where position <= 100""", extra=LEGAL))
def legal_history(d: Domain):
    return consent.legal_history(legal_documents(d), acknowledgements(d))


# Operations ----------------------------------------------------------------------------------

@query("request_rate", twin("""
    select date_trunc('hour', ts) as window_start, route, count(*) as requests, count(*) / 3600.0::double as per_second
    from http_requests group by 1, 2"""))
def request_rate(d: Domain):
    return metrics.request_rate(d.http_requests)


@query("latency_quantiles", twin("""
    select date_trunc('day', ts)::timestamp as window_start, route, count(*) as requests,
      round(quantile_cont(duration_ms, 0.5), 3) as p50, round(quantile_cont(duration_ms, 0.9), 3) as p90,
      round(quantile_cont(duration_ms, 0.95), 3) as p95
    from http_requests group by 1, 2"""))
def latency_quantiles(d: Domain):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return metrics.latency_quantiles(d.http_requests, day)


BOUNDS = (25, 50, 100, 150, 200, 300)


def _histogram_twin(q: float) -> str:
    low, prior, branches = 0, "0", ""
    for b in BOUNDS:
        upto = f"count(*) filter (where duration_ms <= {b})"
        branches += (f" when {upto} >= count(*) * {q}::double then {low} + {b - low} * (count(*) * {q}::double - {prior})"
                     f" / ({upto} - {prior})")
        low, prior = b, upto
    return f"""select date_trunc('hour', ts) as window_start, route, count(*) as n,
        round(case{branches} else {float(BOUNDS[-1])} end, 6)::double as estimate from http_requests group by 1, 2"""


@query("histogram_quantile", twin(_histogram_twin(0.9)))
def histogram_quantile(d: Domain):
    return metrics.histogram_quantile(d.http_requests, BOUNDS, 0.9)


@query("error_ratio", twin("""
    select date_trunc('hour', ts) as window_start, count(*) filter (where status >= 500) as errors, count(*) as requests,
      count(*) filter (where status >= 500)::double / count(*) as error_share from http_requests group by 1"""))
def error_ratio(d: Domain):
    return metrics.error_ratio(d.http_requests)


@query("outcome_counts", """
    select date_trunc('hour', ts) as window_start, count(*) filter (where event_type = 'click') as click,
      count(*) filter (where event_type = 'view') as "view", count(*) filter (where event_type = 'error') as error,
      count(*) filter (where event_type = 'signup') as signup, count(*) filter (where event_type = 'purchase') as purchase
    from events group by 1""")
def outcome_counts(d: Domain):
    return metrics.outcome_counts(
        d.events.select("ts", F.col("event_type").alias("outcome")),
        ["click", "view", "error", "signup", "purchase"])


@query("tokens_per_call", """
    select direction, sum(tokens)::bigint as tokens, max(calls) as calls, round(sum(tokens)::double / max(calls), 6) as per_call
    from (select case when role = 'assistant' then 'output' else 'input' end as direction, (length(text) + 3) // 4 as tokens,
        (select count(*) from conversations where role = 'assistant') as calls from conversations) z group by 1""")
def tokens_per_call(d: Domain):
    direction = F.when(F.col("role") == "assistant", "output").otherwise("input")
    return metrics.tokens_per_call(d.raw("conversations").select(
        direction.alias("direction"), F.expr("(length(text) + 3) div 4").alias("tokens")))


# Window, hold time and limit of each alert, in seconds, shares, milliseconds and counts.
ERROR_SHARE = {"window": 600, "hold": 600, "above": 0.05}
SLOW_ROUTE = {"window": 600, "hold": 900, "above": 2000}
FAILURES = {"window": 600, "hold": 300, "above": 5}
QUEUED = {"hold": 1800, "above": 20}
EXPIRED = {"hold": 1800, "above": 0}
STEP = 60
ALERT_BOUNDS = (100, 250, 500, 1000, 2000, 2500, 5000)


def _sampled_twin(rule: str, breaches: str, hold: int) -> str:
    return f"""
    select '{rule}' as rule, series, make_timestamp(min(instant) * 1000000) as started_at,
      make_timestamp((min(instant) + {hold}) * 1000000) as fired_at, make_timestamp(max(instant) * 1000000) as until
    from (select *, instant // {STEP} - row_number() over (partition by series order by instant) as island from ({breaches}) b) z
    group by series, island having max(instant) - min(instant) >= {hold}"""


def _gauge_twin(rule: str, series: str, above: int, hold: int) -> str:
    return f"""
    select '{rule}', '{series}', min(instant) as started_at, min(instant) + to_seconds({hold}), nullif(max(coalesce(next_at, timestamp '9999-01-01')), timestamp '9999-01-01') as until
    from (select *, sum(case when over and not was_over then 1 else 0 end) over (order by instant) as stretch from (
      select instant, open_jobs > {above} as over, coalesce(lag(open_jobs) over (order by instant), 0) > {above} as was_over, lead(instant) over (order by instant) as next_at
      from backlog where series = '{series}') b) z
    where over group by stretch
    having max(coalesce(next_at, timestamp '9999-01-01')) >= min(instant) + to_seconds({hold})"""


def _slow_twin() -> str:
    counts = ", ".join(f"count(*) filter (where duration_ms <= {b}) as le_{b}" for b in ALERT_BOUNDS)
    low, before, cases = 0, "0", ""
    for b in ALERT_BOUNDS:
        cases += f" when le_{b} >= n * 0.95::double then {low} + ({b} - {low}) * (n * 0.95::double - {before}) / (le_{b} - {before})"
        low, before = b, f"le_{b}"
    return f"""select series, instant from (select route as series, instant, count(*) as n, {counts} from sampled group by route, instant) c
      where case{cases} else {ALERT_BOUNDS[-1]} end > {SLOW_ROUTE["above"]}"""


_ALERTS = " union all ".join([
    _sampled_twin("error_share", f"""select 'all' as series, instant from sampled group by instant
      having count(*) filter (where status >= 500)::double / count(*) > {ERROR_SHARE["above"]}""", ERROR_SHARE["hold"]),
    _sampled_twin("slow_route", _slow_twin(), SLOW_ROUTE["hold"]),
    _sampled_twin("failures", f"""select route as series, instant from sampled where status >= 500 group by route, instant
      having count(*) > {FAILURES["above"]}""", FAILURES["hold"]),
    _gauge_twin("queued", "queued", QUEUED["above"], QUEUED["hold"]),
    _gauge_twin("expired_lease", "expired_lease", EXPIRED["above"], EXPIRED["hold"])])


@query("alert_hold", twin(_ALERTS, f"""sampled as (
      select route, status, duration_ms, (first + k * {STEP})::bigint as instant from (
        select *, ceil(epoch_us(ts) / {STEP}000000.0)::bigint * {STEP} as first from http_requests) r, range({600 // STEP}) t(k))"""))
def alert_hold(d: Domain):
    requests, backlog = d.http_requests, analytics.job_backlog(d.job_runs).withColumnRenamed("open_jobs", "value")
    calls = requests.select("ts", F.col("route").alias("operation"), F.when(F.col("status") >= 500, "error").otherwise("ok").alias("outcome"))
    shares = metrics.error_share_samples(requests, ERROR_SHARE["window"], STEP, ERROR_SHARE["above"])
    slow = metrics.slow_route_samples(requests, SLOW_ROUTE["window"], STEP, SLOW_ROUTE["above"], ALERT_BOUNDS)
    failures = metrics.failure_samples(calls, FAILURES["window"], STEP, FAILURES["above"])
    return metrics.alerts({
        "error_share": (metrics.sampled_holds(shares, STEP, ERROR_SHARE["hold"]), ERROR_SHARE["hold"]),
        "slow_route": (metrics.sampled_holds(slow, STEP, SLOW_ROUTE["hold"]), SLOW_ROUTE["hold"]),
        "failures": (metrics.sampled_holds(failures, STEP, FAILURES["hold"]), FAILURES["hold"]),
        "queued": (metrics.gauge_holds(backlog.where("series = 'queued'"), QUEUED["above"], QUEUED["hold"]), QUEUED["hold"]),
        "expired_lease": (metrics.gauge_holds(
            backlog.where("series = 'expired_lease'"), EXPIRED["above"], EXPIRED["hold"]), EXPIRED["hold"]),
    })
