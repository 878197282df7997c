"""SQL statements of the domain tables, for checking results in another engine.

``twin(query)`` prefixes a statement with the definitions it names, so each
checked query is one self-contained string over the test tables.
"""

from __future__ import annotations

import re

from fitgrid.schemas import AXES, PREFECTURES

_AXIS_ROWS = ", ".join(f"({i}, '{key}')" for i, key in enumerate(AXES))
_PREF_ROWS = ", ".join(f"('{i:02d}', '{n}')" for i, n in enumerate(PREFECTURES, start=1))

# Definitions in dependency order.
DEFINITIONS: dict[str, str] = {
    "ax": f"select * from (values {_AXIS_ROWS}) t(axis_idx, axis_key)",
    "prefs": f"select * from (values {_PREF_ROWS}) t(prefecture_code, prefecture_name)",
    "profile_versions": """
        select o_orderkey as profile_version_id, o_custkey as user_id,
          date_diff('day', date '1990-01-01', cast(o_orderdate as date)) * 1000000000000 + o_orderkey as version,
          case when o_orderkey % 13 = 0 then 2 else 1 end as axis_catalog_version,
          case when o_orderstatus = 'P' then 'draft' else 'completed' end as status,
          o_orderdate as created_at
        from orders""",
    "profile_axis_values": """
        select profile_version_id, axis_key, (profile_version_id*7 + axis_idx*13) % 101 as preference,
          ((profile_version_id + axis_idx) % 5) * 25 as importance
        from profile_versions cross join ax""",
    "target_roles": """
        select o_orderkey as profile_version_id, 1 as role_order, o_orderpriority as role_text from orders
        union all
        select o_orderkey, 2, 'Engineer' from orders where o_orderkey % 2 = 0""",
    "career_constraints": """
        select o_orderkey as profile_version_id,
          case when o_orderkey % 5 <> 0 then 3000000 + (o_orderkey % 8) * 1000000 end as min_salary,
          case when o_orderkey % 4 <> 0 then lpad(cast(1 + o_orderkey % 47 as varchar), 2, '0') end as pref_a,
          case when o_orderkey % 4 <> 0 then lpad(cast(1 + (o_orderkey*5) % 47 as varchar), 2, '0') end as pref_b,
          o_orderkey % 3 = 0 as full_remote_required
        from orders""",
    "educations": """
        select c_custkey as user_id, make_date(cast(2024 + (c_custkey*c_custkey) % 11 as int), 3, 31) as ended_on
        from customer where c_custkey % 6 <> 0
        union all select c_custkey, make_date(2020, 3, 31) from customer where c_custkey % 6 <> 0""",
    "companies": """
        select s_suppkey as company_id, case when s_suppkey % 3 = 0 then '株式会社' || s_name
          when s_suppkey % 3 = 1 then s_name || ' Inc.' else s_name end as company_name from supplier""",
    "job_postings": """
        select p_partkey as job_posting_id, p_partkey % (select count(*) from supplier) as company_id,
          p_name || ' ' || p_type as title,
          'https://jobs.example.com/p/' || p_partkey || '?utm_source=x' as url,
          case when p_partkey % 4 = 0 then 'PART_TIME' else 'FULL_TIME' end as declared_type
        from part""",
    "company_queries": """
        select n_nationkey as query_id, substr(s_name, 1, 17) as company,
          case when n_nationkey % 4 <> 3 then
            (['red ECONOMY', 'blue widget', 'small PROMO'])[n_nationkey % 3 + 1] end as role_query,
          case n_nationkey % 3 when 1 then 'full_time' when 2 then 'part_time' end as employment_type
        from nation join supplier on n_nationkey = s_suppkey""",
    "job_conditions": """
        select p_partkey as job_posting_id,
          case p_partkey % 7 when 0 then 'unknown' when 1 then 'conflicting' when 2 then 'stale' else 'known' end as salary_status,
          p_size * 200000 as salary_minimum, p_size * 200000 + 2000000 as salary_maximum,
          case when p_partkey % 11 = 0 then 'USD' else 'JPY' end as salary_currency,
          case when p_partkey % 9 = 0 then 'unknown' else 'known' end as location_status,
          lpad(cast(1 + p_partkey % 47 as varchar), 2, '0') as prefecture,
          case when p_partkey % 8 = 0 then 'conflicting' else 'known' end as remote_status,
          p_partkey % 2 = 0 as full_remote
        from part""",
    "evaluations": """
        select l_orderkey*10 + l_linenumber as evaluation_id, l_orderkey,
          min(l_partkey) as job_posting_id, min(l_suppkey) as company_id,
          case when l_linenumber = 1 and l_orderkey % 4 = 0 then 'company' else 'job' end as target_type,
          case when l_orderkey % 17 = 0 then 2 else 1 end as axis_catalog_version,
          'public-rules-v' || (l_orderkey % 3 + 1) as evaluator_version,
          max(l_shipdate) as created_at
        from lineitem group by l_orderkey, l_linenumber""",
    "evaluated_axis_values": """
        select evaluation_id, axis_key,
          case when evaluation_id % 19 = 0 and axis_idx = 3 then 2 else axis_catalog_version end as axis_version,
          case when k = 1 then 'unknown' when k = 2 then 'conflicting' when k = 3 then 'stale'
            when k in (4, 5) then 'range' else 'known' end as observation_status,
          case when k in (3, 5, 7, 9) then 50 when k in (4, 6) then 0 when k = 8 then 100 end as anchor_value,
          case when k = 4 then 50 when k = 5 then 100 end as anchor_max
        from (select evaluation_id, axis_key, axis_idx, axis_catalog_version,
                (job_posting_id*3 + company_id + axis_idx*5) % 10 as k
              from evaluations cross join ax) z where k <> 0""",
    "evaluation_sources": """
        select evaluation_id, created_at - to_days(cast(evaluation_id % 40 as int)) as fetched_at from evaluations
        union all
        select evaluation_id, created_at - to_days(cast(evaluation_id % 90 as int)) from evaluations""",
    "requested_pairs": """
        select e.evaluation_id as match_result_id, p.user_id, p.profile_version_id, e.evaluation_id,
          e.job_posting_id, e.company_id, e.target_type, p.axis_catalog_version as profile_catalog_version,
          e.axis_catalog_version as target_version, e.created_at
        from evaluations e join profile_versions p on p.profile_version_id = e.l_orderkey
        where p.status = 'completed'""",
    "match_results": """
        select match_result_id, user_id, profile_version_id, evaluation_id, job_posting_id, company_id, created_at
        from requested_pairs where target_type = 'job' and profile_catalog_version = target_version""",
    "axis_inputs": """
        select m.match_result_id, a.axis_key, v.preference, v.importance,
          coalesce(o.observation_status, 'unknown') as observation_status, o.anchor_value, o.anchor_max
        from match_results m cross join ax a
        join profile_axis_values v on v.profile_version_id = m.profile_version_id and v.axis_key = a.axis_key
        left join evaluated_axis_values o on o.evaluation_id = m.evaluation_id and o.axis_key = a.axis_key""",
    "axis_results": """
        select match_result_id, axis_key, preference, importance, observation_status, anchor_value, anchor_max,
          case when importance = 0 then 'excluded'
            when observation_status = 'known' then case when abs(preference - anchor_value) <= 25 then 'close' else 'different' end
            when observation_status = 'range' then
              case when greatest(abs(preference - anchor_value), abs(preference - anchor_max)) <= 25 then 'close'
                when least(abs(preference - anchor_value), abs(preference - anchor_max)) > 25 then 'different'
                else 'partial' end
            else observation_status end as comparison_status,
          case when importance <> 0 and observation_status = 'known' then abs(preference - anchor_value)
            when importance <> 0 and observation_status = 'range'
              then least(abs(preference - anchor_value), abs(preference - anchor_max)) end as difference,
          case when importance <> 0 and observation_status = 'range'
            then greatest(abs(preference - anchor_value), abs(preference - anchor_max)) end as difference_max
        from axis_inputs""",
    "axis_counts": """
        select match_result_id,
          count(*) filter (where comparison_status = 'close') as close_count,
          count(*) filter (where comparison_status = 'different') as different_count,
          count(*) filter (where comparison_status = 'partial') as partial_count,
          count(*) filter (where comparison_status in ('unknown', 'conflicting', 'stale')) as unknown_count
        from axis_results group by 1""",
    "constraint_inputs": """
        select m.match_result_id, c.*, j.* exclude (job_posting_id)
        from match_results m join career_constraints c using (profile_version_id)
        left join job_conditions j on j.job_posting_id = m.job_posting_id""",
    "salary_results": """
        select match_result_id, 'min_salary' as kind,
          case when min_salary is null then 'not_required'
            when coalesce(salary_status, 'unknown') <> 'known' then 'unknown'
            when salary_currency <> 'JPY' then 'unknown'
            when salary_minimum >= min_salary then 'met'
            when salary_maximum < min_salary then 'unmet' else 'unknown' end as status,
          case when min_salary is null then null
            when salary_status = 'conflicting' then 'conflicting_information'
            when salary_status = 'stale' then 'stale_information'
            when coalesce(salary_status, 'unknown') <> 'known' then 'missing_information'
            when salary_currency <> 'JPY' then 'salary_unit_mismatch'
            when salary_minimum >= min_salary then null
            when salary_maximum < min_salary then 'salary_below_minimum'
            else 'salary_range_overlaps_minimum' end as reason
        from constraint_inputs""",
    "location_results": """
        select match_result_id, 'location' as kind,
          case when pref_a is null then 'not_required'
            when coalesce(location_status, 'unknown') <> 'known' then 'unknown'
            when prefecture in (pref_a, pref_b) then 'met' else 'unmet' end as status,
          case when pref_a is null then null
            when coalesce(location_status, 'unknown') <> 'known' then 'missing_information'
            when prefecture in (pref_a, pref_b) then null else 'location_outside_allowed' end as reason
        from constraint_inputs""",
    "remote_results": """
        select match_result_id, 'full_remote' as kind,
          case when not full_remote_required then 'not_required'
            when coalesce(remote_status, 'unknown') <> 'known' then 'unknown'
            when full_remote then 'met' else 'unmet' end as status,
          case when not full_remote_required then null
            when remote_status = 'conflicting' then 'conflicting_information'
            when coalesce(remote_status, 'unknown') <> 'known' then 'missing_information'
            when full_remote then null else 'regular_office_attendance_required' end as reason
        from constraint_inputs""",
    "constraint_results": """
        select * from salary_results union all select * from location_results
        union all select * from remote_results""",
    "analysis_jobs": """
        select o_orderkey as job_id, o_custkey as user_id, o_orderkey % 500 as url_id,
          case o_orderstatus when 'P' then 'queued' when 'O' then 'running' else 'completed' end as status,
          o_orderkey % 5 as attempts, o_orderdate as created_at,
          case when o_orderstatus = 'O' then o_orderdate + to_days(cast(o_orderkey % 30 as int)) end as lease_until,
          case when o_orderstatus = 'F' then o_orderkey * 10 + 2 end as evaluation_id
        from orders""",
    "job_runs": """
        select job_id, queued_at, case when state <> 'P' then leased_at end as leased_at,
          case when state <> 'P' then leased_at + to_hours(job_id % 30) end as lease_until,
          case when state = 'F' then leased_at + to_hours(job_id % 45)
            when state = 'P' and job_id % 3 = 0 then queued_at + to_hours(job_id % 200) end as ended_at
        from (select o_orderkey as job_id, o_orderstatus as state, o_orderdate + to_minutes(o_orderkey * 37 % 1440) as queued_at,
          o_orderdate + to_minutes(o_orderkey * 37 % 1440) + to_hours(1 + o_orderkey % 50) as leased_at from orders) z""",
    "backlog_spans": """
        select 'queued' as series, queued_at as since, coalesce(leased_at, ended_at) as until from job_runs
        union all select 'expired_lease', lease_until, ended_at from job_runs where leased_at is not null""",
    "backlog": """
        select series, instant, count(*) filter (where up) as entered, count(*) filter (where not up) as "left",
          sum(sum(case when up then 1 else -1 end)) over (partition by series order by instant)::bigint as open_jobs
        from (select series, since as instant, true as up from backlog_spans where until is null or until > since
          union all select series, until, false from backlog_spans where until > since) z group by series, instant""",
    "abuse_events": """
        select event_id, user_id, ts,
          case event_type when 'click' then 'analysis_new' when 'view' then 'analysis_cached'
            when 'error' then 'analysis_quota_rejected' when 'signup' then 'career_profile_saved'
            else 'share_created' end as event_type,
          case when event_id % 20 <> 0 then sha256(cast(cast(ts as date) as varchar) || '|' || regexp_extract(props, '([0-9]+)', 1)) end as ip_key,
          sha256(cast(cast(ts as date) as varchar) || '|' || (user_id % 7)) as ua_key
        from events""",
    "consent_policies": """
        select policy_id, purpose, version, cast(effective as timestamp) as effective_at from (values
          (1, 'community_benchmark', '1.0', '2023-12-01'), (2, 'community_benchmark', '2.0', '2024-01-15'),
          (3, 'community_benchmark', '3.0', '2024-03-01'), (4, 'external_aggregate_use', '1.0', '2023-12-01'))
          t(policy_id, purpose, version, effective)""",
    "consent_events": """
        select event_id, user_id, 'community_benchmark' as purpose,
          case when ts < timestamp '2024-01-15' then 1 else 2 end as policy_id,
          case when event_type = 'signup' then 'granted' else 'withdrawn' end as action, ts as recorded_at
        from events where event_type in ('signup', 'error')""",
    "current_policies": """
        select * exclude (r) from (select *, row_number() over (partition by purpose order by effective_at desc, policy_id desc) as r
          from consent_policies where effective_at <= timestamp '2024-01-31') where r = 1""",
    "consented_users": """
        select l.purpose, l.user_id from (select *, row_number() over (partition by purpose, user_id
            order by recorded_at desc, event_id desc) as r
          from consent_events where recorded_at <= timestamp '2024-01-31') l
        join current_policies c on c.purpose = l.purpose and c.policy_id = l.policy_id
        where l.r = 1 and l.action = 'granted'""",
    "requests": """
        select event_id, user_id, ts, event_type, event_id % 40 as url_id from events where event_type in ('click', 'view')""",
    "http_requests": """
        select event_id, ts, event_type as route,
          case when event_type = 'error' and value > 15 then 500 else 200 end as status,
          cast(round(value * 10) as bigint) as duration_ms from events""",
    "posting_fragments": """
        select * from (
          select p_partkey as document_id, 1 as position, '給与' as section, case when p_partkey % 4 = 0 then '月給 30万円'
            else '年収 ' || (300 + p_size*5) || '万円〜' || (400 + p_size*10) || '万円' end as text from part
          union all select p_partkey, 2, '働き方', case p_partkey % 3 when 0 then '週2日出社。' when 1 then 'フルリモート可' else '原則出社です。' end from part
          union all select p_partkey, 3, '勤務時間', case p_partkey % 5 when 0 then 'コアタイムなし' when 1 then 'フレックスタイム制' else '固定勤務時間' end from part
          union all select p_partkey, 4, '給与', case when p_partkey % 10 = 1 then '年収 500万円〜700万円' end from part
          union all select p_partkey, 5, '勤務地', '勤務地： ' || (['東京都', '大阪府', '北海道', 'Yokohama', '福岡市'])[p_partkey % 5 + 1]
            || case when p_partkey % 6 = 0 then '（将来的に変更）' else '' end || ' 休日 土日' from part
          union all select p_partkey, 6, '技術スタック', case when p_partkey % 2 = 0 then '技術スタック: ' || p_brand || '、Python' else 'We use TypeScript and go fast with AWS' end from part
          union all select p_partkey, 7, '雇用形態', case p_partkey % 3 when 0 then '雇用形態 正社員' when 1 then '雇用形態 業務委託' else '雇用形態は面談で決定' end from part
          union all select p_partkey, 8, '求める人物像', p_name || ' の経験。連絡先 hr' || p_partkey || '@example.com' from part
          union all select p_partkey, 9, '業務内容', p_type || ' の設計と開発' from part
        ) z where text is not null""",
    "judgements": """
        select p_partkey as document_id, axis_key, axis_idx,
          1 + (p_partkey*7 + axis_idx) % 40 as w0, 1 + (p_partkey*3 + axis_idx*11) % 25 as w50,
          1 + (p_partkey + axis_idx*5) % 10 as w100
        from part cross join ax""",
    "judgement_evidence": """
        select document_id, axis_key, position,
          case position when 1 then 40 + (document_id + axis_idx) % 21 when 2 then 15 + (document_id*3 + axis_idx) % 21
            else 5 + (document_id*5 + axis_idx*3) % 21 end as weight,
          case when position = 1 and document_id % 6 = 0 then '変更の範囲：会社の定める業務'
            when position = 2 and document_id % 4 = 0 then 'フレックスタイム制の勤務時間'
            else '設計方針を自分で決める' end as text
        from judgements cross join (values (1), (2), (3)) f(position)""",
}


def _needed(statement: str, found: set[str]) -> set[str]:
    for name, body in DEFINITIONS.items():
        if name not in found and re.search(rf"\b{name}\b", statement):
            found.add(name)
            _needed(body, found)
    return found


def twin(statement: str, extra: str = "", recursive: bool = False) -> str:
    """``statement`` with the definitions it uses; ``extra`` adds definitions of its own."""
    needed = _needed(statement + " " + extra, set())
    parts = [f"{name} as ({body})" for name, body in DEFINITIONS.items() if name in needed]
    if extra:
        parts.append(extra)
    if not parts:
        return statement
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + statement
