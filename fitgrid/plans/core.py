"""Matching, history and sharing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitgrid.bindings import Domain, ntz
from fitgrid.operators import history, matching
from fitgrid.plans.registry import query
from fitgrid.plans.twins import twin

FRESH_AFTER = "1997-01-01 00:00:00"


def comparisons(d: Domain):
    return matching.compare_axes(
        d.match_results.select("match_result_id", "profile_version_id", "evaluation_id"),
        d.profile_axis_values, d.evaluated_axis_values)


@query("axis_comparison", twin(
    "select match_result_id, axis_key, preference, importance, comparison_status, difference from axis_results"))
def axis_comparison(d: Domain):
    return comparisons(d).select(
        "match_result_id", "axis_key", "preference", "importance", "comparison_status", "difference")


@query("axis_range_comparison", twin("""
    select match_result_id, axis_key, anchor_value, anchor_max, comparison_status, difference, difference_max
    from axis_results where observation_status = 'range'"""))
def axis_range_comparison(d: Domain):
    ranged = d.evaluated_axis_values.where("observation_status = 'range'")
    return comparisons_with(d, ranged).where("observation_status = 'range'").select(
        "match_result_id", "axis_key", "anchor_value", "anchor_max", "comparison_status",
        "difference", "difference_max")


def comparisons_with(d: Domain, observed):
    return matching.compare_axes(
        d.match_results.select("match_result_id", "profile_version_id", "evaluation_id"),
        d.profile_axis_values, observed)


@query("version_compatibility", twin("""
    select p.match_result_id, p.target_type,
      case when p.target_version <> p.profile_catalog_version or coalesce(v.mixed, false) then 'incompatible' else 'comparable' end as compatibility,
      case when p.target_version <> p.profile_catalog_version or coalesce(v.mixed, false) then 'axis_version_mismatch' end as incompatible_reason
    from requested_pairs p left join (
      select q.match_result_id, bool_or(a.axis_version <> q.profile_catalog_version) as mixed
      from requested_pairs q join evaluated_axis_values a on a.evaluation_id = q.evaluation_id group by 1) v
    on v.match_result_id = p.match_result_id"""))
def version_compatibility(d: Domain):
    return matching.version_compatibility(d.requested_pairs, d.evaluated_axis_values).select(
        "match_result_id", "target_type", "compatibility", "incompatible_reason")


def constraint_inputs(d: Domain):
    return matching.constraint_inputs(
        d.match_results.select("match_result_id", "profile_version_id", "job_posting_id"),
        d.career_constraints, d.job_conditions)


@query("salary_constraint", twin("select match_result_id, status, reason from salary_results"))
def salary_constraint(d: Domain):
    return matching.constraint_rows(constraint_inputs(d), matching.salary_result()).drop("kind")


@query("location_constraint", twin("select match_result_id, status, reason from location_results"))
def location_constraint(d: Domain):
    return matching.constraint_rows(constraint_inputs(d), matching.location_result()).drop("kind")


@query("remote_constraint", twin("select match_result_id, status, reason from remote_results"))
def remote_constraint(d: Domain):
    return matching.constraint_rows(constraint_inputs(d), matching.remote_result()).drop("kind")


@query("hard_constraints", twin("""
    select match_result_id, kind, status, reason,
      bool_or(status = 'unmet') over (partition by match_result_id) as has_hard_conflict
    from constraint_results"""))
def hard_constraints(d: Domain):
    return matching.hard_constraints(
        d.match_results.select("match_result_id", "profile_version_id", "job_posting_id"),
        d.career_constraints, d.job_conditions)


@query("axis_status_counts", twin("select * from axis_counts"))
def axis_status_counts(d: Domain):
    return matching.axis_status_counts(comparisons(d))


@query("match_summary", twin("""
    select c.*, h.has_hard_conflict from axis_counts c join (
      select match_result_id, bool_or(status = 'unmet') as has_hard_conflict from constraint_results group by 1) h
    on h.match_result_id = c.match_result_id"""))
def match_summary(d: Domain):
    return matching.match_summary(
        d.match_results.select("match_result_id", "profile_version_id", "evaluation_id", "job_posting_id"),
        d.profile_axis_values, d.evaluated_axis_values, d.career_constraints, d.job_conditions)


LATEST_COMPANY = """latest_company as (select company_id, evaluation_id, created_at from (
    select *, row_number() over (partition by company_id order by created_at desc, evaluation_id desc) as r
    from evaluations where target_type = 'company') z where r = 1)"""
LATEST_JOB = """latest_job as (select job_posting_id, evaluation_id, created_at from (
    select *, row_number() over (partition by job_posting_id order by created_at desc, evaluation_id desc) as r
    from evaluations where target_type = 'job') z where r = 1)"""


@query("company_reference_comparison", twin("""
    select match_result_id, company_id, evaluation_id, axis_key,
      case when importance = 0 then 'excluded'
        when s = 'known' then case when abs(preference - lo) <= 25 then 'close' else 'different' end
        when s = 'range' then case when greatest(abs(preference - lo), abs(preference - hi)) <= 25 then 'close'
          when least(abs(preference - lo), abs(preference - hi)) > 25 then 'different' else 'partial' end
        else s end as comparison_status
    from (select m.match_result_id, m.company_id, l.evaluation_id, a.axis_key, v.preference, v.importance,
        coalesce(o.observation_status, 'unknown') as s, o.anchor_value as lo, o.anchor_max as hi
      from match_results m join latest_company l on l.company_id = m.company_id cross join ax a
      join profile_axis_values v on v.profile_version_id = m.profile_version_id and v.axis_key = a.axis_key
      left join evaluated_axis_values o on o.evaluation_id = l.evaluation_id and o.axis_key = a.axis_key) z""",
    extra=LATEST_COMPANY))
def company_reference_comparison(d: Domain):
    return matching.company_reference(
        d.match_results, d.evaluations, d.profile_axis_values, d.evaluated_axis_values
    ).select("match_result_id", "company_id", "evaluation_id", "axis_key", "comparison_status")


@query("match_batch", twin("""
    select profile_version_id, evaluation_id, user_id, 'match-v3' as algorithm_version
    from (select distinct p.profile_version_id, r.evaluation_id, p.user_id
      from latest_profiles p join (select q.user_id, e.evaluation_id, e.axis_catalog_version from requests q
          join evaluations e on e.job_posting_id = q.url_id where e.target_type = 'job') r
        on r.user_id = p.user_id and r.axis_catalog_version = p.axis_catalog_version) w
    where not exists (select 1 from match_results m where m.profile_version_id = w.profile_version_id
      and m.evaluation_id = w.evaluation_id)""",
    extra="""latest_profiles as (select * from (select *, row_number() over (partition by user_id order by version desc) as r
      from profile_versions where status = 'completed') z where r = 1)"""))
def match_batch(d: Domain):
    asked = d.requests.select("user_id", F.col("url_id").alias("job_posting_id")).distinct()
    jobs = d.evaluations.where("target_type = 'job'").select(
        "job_posting_id", "evaluation_id", "axis_catalog_version")
    requested = asked.join(jobs, "job_posting_id").select("user_id", "evaluation_id", "axis_catalog_version")
    return matching.new_matches(
        history.latest_completed_profiles(d.profile_versions), requested, d.match_results, "match-v3"
    ).select("profile_version_id", "evaluation_id", "user_id", "algorithm_version")


@query("match_snapshot_mismatch", twin("""
    select match_result_id, axis_key, match_result_id % 7 = 0 and axis_key = 'autonomy' as answer_differs,
      (match_result_id % 11 = 0 and axis_key = 'work_change' and observation_status <> 'stale') as observation_differs
    from axis_inputs where (match_result_id % 7 = 0 and axis_key = 'autonomy')
      or (match_result_id % 11 = 0 and axis_key = 'work_change' and observation_status <> 'stale')"""))
def match_snapshot_mismatch(d: Domain):
    # Stored snapshots, some of which were written before an answer or observation changed.
    key, axis = F.col("match_result_id"), F.col("axis_key")
    old_answer = (key % 7 == 0) & (axis == "autonomy")
    old_observation = (key % 11 == 0) & (axis == "work_change")
    stored = comparisons(d).select(
        "match_result_id", "profile_version_id", "evaluation_id", "axis_key",
        (F.col("preference") + F.when(old_answer, 1).otherwise(0)).alias("preference"), "importance",
        F.when(old_observation, "stale").otherwise(F.col("observation_status")).alias("observation_status"),
        "anchor_value", "anchor_max")
    return matching.snapshot_mismatches(stored, d.profile_axis_values, d.evaluated_axis_values)


@query("match_report", twin("""
    select a.match_result_id, a.axes, c.constraints, p.title as job_title from
      (select r.match_result_id, string_agg(r.axis_key || '=' || r.comparison_status
          || coalesce('[' || case when e.observation_status in ('known', 'range') then e.axis_key end || ']', ''), ';' order by x.axis_idx) as axes
        from axis_results r join ax x on x.axis_key = r.axis_key
        join match_results m on m.match_result_id = r.match_result_id
        left join evaluated_axis_values e on e.evaluation_id = m.evaluation_id and e.axis_key = r.axis_key group by 1) a
      join (select match_result_id, string_agg(kind || '=' || status, ';' order by case kind when 'min_salary' then 1 when 'location' then 2 else 3 end) as constraints
        from constraint_results group by 1) c using (match_result_id)
      join match_results m using (match_result_id) join job_postings p using (job_posting_id)"""))
def match_report(d: Domain):
    evidence = d.evaluated_axis_values.where("observation_status in ('known', 'range')").select(
        "evaluation_id", "axis_key", F.lit("main").alias("locator"), F.col("axis_key").alias("excerpt"))
    compared = matching.compare_axes(
        d.match_results.select("match_result_id", "profile_version_id", "evaluation_id", "job_posting_id"),
        d.profile_axis_values, d.evaluated_axis_values)
    results = matching.hard_constraints(d.match_results, d.career_constraints, d.job_conditions)
    def line(axes):
        return F.array_join(F.transform(axes, lambda a: F.concat(
            a["axis_key"], F.lit("="), a["comparison_status"],
            F.when(F.size(a["evidence"]) > 0, F.concat(F.lit("["), a["evidence"][0]["excerpt"], F.lit("]")))
            .otherwise(""))), ";")
    def verdicts(constraints):
        return F.array_join(F.transform(constraints, lambda c: F.concat_ws("=", c["kind"], c["status"])), ";")
    report = matching.match_reports(
        compared, evidence, results, d.job_postings.select("job_posting_id", "title"), line, verdicts)
    return report.select("match_result_id", "axes", "constraints", F.col("title").alias("job_title"))


def projections(d: Domain):
    names = d.match_results.join(d.job_postings.select("job_posting_id", "title"), "job_posting_id") \
        .join(d.companies, "company_id") \
        .select("match_result_id", "company_name", F.col("title").alias("job_title"),
                F.col("created_at").alias("evaluated_at"))
    return matching.share_projections(comparisons(d), names)


@query("share_projection", twin("""
    select m.match_result_id, c.company_name, p.title as job_title, m.created_at as evaluated_at, a.axes
    from match_results m join job_postings p using (job_posting_id) join companies c on c.company_id = m.company_id
    join (select match_result_id, string_agg(r.axis_key || '=' || comparison_status, ';' order by axis_idx) as axes
      from axis_results r join ax x on x.axis_key = r.axis_key group by 1) a using (match_result_id)"""))
def share_projection(d: Domain):
    return projections(d).withColumn("axes", F.array_join(
        F.transform("axes", lambda a: F.concat_ws("=", a["axis_key"], a["status"])), ";"))


@query("share_summary", twin("""
    select c.match_result_id, close_count as "close", different_count as "different", partial_count as "partial",
      unknown_count as "unknown", coalesce(t.close_axes, '') as close_axes
    from axis_counts c left join (select match_result_id, string_agg(axis_key, ';' order by axis_idx) as close_axes
      from (select r.match_result_id, r.axis_key, x.axis_idx,
          row_number() over (partition by r.match_result_id order by x.axis_idx) as n
        from axis_results r join ax x on x.axis_key = r.axis_key where comparison_status = 'close') z
      where n <= 3 group by 1) t using (match_result_id)"""))
def share_summary(d: Domain):
    return matching.share_summaries(projections(d)).withColumn("close_axes", F.array_join("close_axes", ";"))


@query("latest_match_per_job", twin("""
    select user_id, job_posting_id, match_result_id, created_at from (select *, row_number() over (
      partition by user_id, job_posting_id order by created_at desc, match_result_id desc) as r from match_results) z where r = 1"""))
def latest_match_per_job(d: Domain):
    return history.latest_match_per_job(d.match_results).select(
        "user_id", "job_posting_id", "match_result_id", "created_at")


@query("latest_evaluation", twin("""
    select 'job' as target_type, job_posting_id as target_id, evaluation_id, created_at from latest_job
    union all select 'company', company_id, evaluation_id, created_at from latest_company""",
    extra=LATEST_JOB + ", " + LATEST_COMPANY))
def latest_evaluation(d: Domain):
    def latest(kind, key):
        return matching.latest_evaluations(d.evaluations, kind, key).select(
            "target_type", F.col(key).alias("target_id"), "evaluation_id", "created_at")
    return latest("job", "job_posting_id").unionByName(latest("company", "company_id"))


@query("latest_completed_profile", twin("""
    select user_id, profile_version_id, version from (select *, row_number() over (
      partition by user_id order by version desc) as r from profile_versions where status = 'completed') z where r = 1"""))
def latest_completed_profile(d: Domain):
    return history.latest_completed_profiles(d.profile_versions).select(
        "user_id", "profile_version_id", "version")


@query("profile_revisions", twin("""
    select * from (
      select p.user_id, p.profile_version_id, lag(p.profile_version_id) over w as previous_profile_version_id, v.axis_key,
        v.preference - lag(v.preference) over w as preference_change, v.importance - lag(v.importance) over w as importance_change
      from profile_versions p join profile_axis_values v on v.profile_version_id = p.profile_version_id where p.status = 'completed'
      window w as (partition by p.user_id, v.axis_key order by p.version)) z
    where previous_profile_version_id is not null"""))
def profile_revisions(d: Domain):
    return history.profile_revisions(d.profile_versions, d.profile_axis_values)


@query("oldest_source_freshness", twin(f"""
    select m.match_result_id, m.evaluation_id, s.oldest_fetched_at,
      coalesce(r.reason = 'stale_information', false) or coalesce(s.oldest_fetched_at < timestamp '{FRESH_AFTER}', false) as stale_conditions
    from match_results m left join (select evaluation_id, min(fetched_at) as oldest_fetched_at from evaluation_sources group by 1) s
      using (evaluation_id) join salary_results r using (match_result_id)"""))
def oldest_source_freshness(d: Domain):
    return history.stale_flags(
        d.match_results, d.evaluation_sources, d.career_constraints, d.job_conditions, ntz(FRESH_AFTER))


def history_page(d: Domain, **options):
    by_order, by_evaluation = d.dealt_by("l_orderkey"), d.dealt_by("evaluation_id")
    return history.analysis_history(
        by_order.match_results, d.evaluations, d.profile_versions, d.profile_axis_values,
        by_evaluation.evaluated_axis_values, d.target_roles, d.job_postings, d.companies, by_evaluation.evaluation_sources,
        d.career_constraints, d.job_conditions, ntz(FRESH_AFTER), **options
    ).withColumn("target_roles", F.array_join("target_roles", ";"))


HISTORY = f"""
    select p.user_id, page_row, p.job_posting_id, p.match_result_id, p.created_at as analyzed_at, p.profile_version_id,
      v.version as profile_version, p.target_roles, j.title as job_title, p.company_id, c.company_name,
      p.evaluation_id as job_evaluation_id, l.evaluation_id as company_evaluation_id, l.created_at as company_evaluated_at,
      close_count, different_count, partial_count, unknown_count, stale_conditions, sort_count
    from (select *, row_number() over (partition by user_id order by sort_count desc, created_at desc, match_result_id desc) as page_row
      from (select m.*, k.* exclude (match_result_id), {{sort}} as sort_count, ro.target_roles,
          coalesce(s.reason = 'stale_information', false) or coalesce(f.oldest < timestamp '{FRESH_AFTER}', false) as stale_conditions
        from (select * from (select *, row_number() over (partition by user_id, job_posting_id
            order by created_at desc, match_result_id desc) as r from match_results) z where r = 1) m
        join axis_counts k using (match_result_id) join salary_results s using (match_result_id)
        left join (select evaluation_id, min(fetched_at) as oldest from evaluation_sources group by 1) f using (evaluation_id)
        join (select profile_version_id, string_agg(role_text, ';' order by role_order) as target_roles,
            list(role_text) as role_list from target_roles group by 1) ro using (profile_version_id)
        where {{where}}) e) p
    join profile_versions v using (profile_version_id) join job_postings j using (job_posting_id)
    join companies c on c.company_id = p.company_id left join latest_company l on l.company_id = p.company_id
    where page_row <= 21"""


@query("analysis_history_page", twin(
    HISTORY.format(sort="0", where="true"), extra=LATEST_COMPANY))
def analysis_history_page(d: Domain):
    return history_page(d, limit=20)


@query("analysis_history_filtered", twin(
    HISTORY.format(sort="close_count", where="close_count > different_count and list_contains(role_list, 'Engineer')"),
    extra=LATEST_COMPANY))
def analysis_history_filtered(d: Domain):
    return history_page(d, limit=20, role="Engineer", judgement="mostly_close", sort="close")


@query("saved_jobs_page", twin("""
    select p.user_id, page_row, p.job_posting_id, saved_at, title, company_name,
      a.evaluation_id as job_evaluation_id, b.evaluation_id as company_evaluation_id
    from (select *, row_number() over (partition by user_id order by saved_at desc, job_posting_id desc) as page_row
      from (select user_id, job_posting_id, max(created_at) as saved_at from match_results group by 1, 2) s) p
    join job_postings j using (job_posting_id) join companies c on c.company_id = j.company_id
    left join latest_job a on a.job_posting_id = p.job_posting_id
    left join latest_company b on b.company_id = j.company_id where page_row <= 11""",
    extra=LATEST_JOB + ", " + LATEST_COMPANY))
def saved_jobs_page(d: Domain):
    saved = d.match_results.groupBy("user_id", "job_posting_id").agg(F.max("created_at").alias("saved_at"))
    return history.saved_jobs(saved, d.evaluations, d.job_postings, d.companies, limit=10)


@query("unmatched_evaluations", twin("""
    select user_id, position, requested_at, url_id, evaluation_id from (
      select *, row_number() over (partition by user_id order by requested_at, url_id) as position from (
        select * from (select w.*, row_number() over (partition by user_id, requested_at, url_id order by evaluation_id) as r
          from (select user_id, url_id, created_at as requested_at,
              coalesce(evaluation_id, case when job_id % 2 = 0 then job_id * 10 + 1 end) as evaluation_id from analysis_jobs) w
          where evaluation_id is not null and not exists (select 1 from match_results m
            where m.user_id = w.user_id and m.evaluation_id = w.evaluation_id)) z where r = 1) y) x
    where position <= 20"""))
def unmatched_evaluations(d: Domain):
    jobs = d.analysis_jobs
    requests = jobs.select(
        "user_id", "url_id", "job_id", F.col("created_at").alias("requested_at"),
        F.when(F.col("job_id") % 2 == 0, F.col("job_id") * 10 + 1).alias("requested_evaluation_id"))
    return history.unmatched_evaluations(requests, jobs, d.match_results, limit=20)
