"""Latest-per-key reads and the pages built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrid.functions.axes import status_counts
from fitgrid.operators.keyed import moved, newest, split_lag, top_per_key
from fitgrid.operators.matching import (
    answer_numbers, axis_status_counts, compare_numbers, constraint_inputs, latest_evaluations,
    observation_numbers, salary_result, stale_salaries,
)


def latest_match_per_job(matches: DataFrame) -> DataFrame:
    return top_per_key(matches, ["user_id", "job_posting_id"], newest("created_at", "match_result_id"))


def latest_completed_profiles(profile_versions: DataFrame) -> DataFrame:
    return top_per_key(profile_versions.where("status = 'completed'"), ["user_id"], newest("version"))


def profile_revisions(profile_versions: DataFrame, profile_axis_values: DataFrame) -> DataFrame:
    """Each completed version against the one before: preference and importance deltas per axis.

    The step is taken on version rows; the eight answers join afterwards, so a
    user with very many versions never gathers eight times as many rows.
    """
    done = profile_versions.where("status = 'completed'").withColumn(
        "month", F.date_trunc("month", "created_at"))
    steps = split_lag(done, ["user_id"], "month", ["version"], ["profile_version_id"]) \
        .where("previous_profile_version_id is not null") \
        .select("user_id", "profile_version_id", "previous_profile_version_id")
    before = profile_axis_values.select(
        F.col("profile_version_id").alias("previous_profile_version_id"), "axis_key",
        F.col("preference").alias("old_preference"), F.col("importance").alias("old_importance"))
    return (
        steps.join(moved(profile_axis_values), "profile_version_id")
        .join(moved(before), ["previous_profile_version_id", "axis_key"])
        .select("user_id", "profile_version_id", "previous_profile_version_id", "axis_key",
                (F.col("preference") - F.col("old_preference")).alias("preference_change"),
                (F.col("importance") - F.col("old_importance")).alias("importance_change"))
    )


def source_freshness(
    evaluation_sources: DataFrame, stale_after: Column
) -> DataFrame:
    """Oldest source time per evaluation and whether it lies before the boundary."""
    return evaluation_sources.groupBy("evaluation_id").agg(
        F.min("fetched_at").alias("oldest_fetched_at")
    ).withColumn("is_stale", F.col("oldest_fetched_at") < stale_after)


def stale_flags(
    matches: DataFrame, sources: DataFrame, constraints: DataFrame, conditions: DataFrame,
    fresh_after: Column,
) -> DataFrame:
    """Stale when the oldest source is too old or a constraint rests on stale information."""
    fresh = source_freshness(sources, fresh_after)
    condition = constraint_inputs(
        matches.select("match_result_id", "profile_version_id", "job_posting_id"),
        constraints, conditions,
    ).select("match_result_id", F.coalesce(
        salary_result()["reason"] == "stale_information", F.lit(False)).alias("stale_condition"))
    return (
        matches.join(fresh, "evaluation_id", "left").join(condition, "match_result_id", "left")
        .select("match_result_id", "evaluation_id", "oldest_fetched_at",
                (F.coalesce("stale_condition", F.lit(False))
                 | F.coalesce("is_stale", F.lit(False))).alias("stale_conditions"))
    )


JUDGEMENTS = {
    "all": lambda: F.lit(True),
    "mostly_close": lambda: F.col("close_count") > F.col("different_count"),
    "has_different": lambda: F.col("different_count") > 0,
    "has_unknown": lambda: F.col("unknown_count") > 0,
}
SORTS = {
    "recent": lambda: F.lit(0).cast("bigint"),
    "close": lambda: F.col("close_count"),
    "fewest_unknown": lambda: -F.col("unknown_count"),
}


def analysis_history(
    matches: DataFrame, evaluations: DataFrame, profile_versions: DataFrame,
    profile_axis_values: DataFrame, evaluated_axis_values: DataFrame, target_roles: DataFrame,
    postings: DataFrame, companies: DataFrame, sources: DataFrame, constraints: DataFrame,
    conditions: DataFrame, fresh_after: Column, *, limit: int, role: str | None = None,
    judgement: str = "all", sort: str = "recent", after: DataFrame | None = None,
) -> DataFrame:
    """History page of every user at once, ``limit + 1`` rows each.

    Only the newest match per posting is compared and enriched. ``after`` holds
    one keyset cursor per user (user_id, sort_count, analyzed_at, match_result_id);
    users without a cursor get their first page.
    """
    latest = latest_match_per_job(matches).withColumnRenamed("created_at", "analyzed_at")
    roles = target_roles.groupBy("profile_version_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("role_order", "role_text"))),
                    lambda r: r["role_text"]).alias("target_roles"))
    # Rows are narrow while they visit the posting and the evaluation and grow wide
    # where the profile is, so the answers never move with a match.
    rows = (
        latest.join(moved(stale_salaries(conditions)), "job_posting_id", "left")
        .join(moved(source_freshness(sources, fresh_after).select("evaluation_id", "is_stale")), "evaluation_id", "left")
        .join(moved(observation_numbers(evaluated_axis_values)), "evaluation_id", "left")
        .join(profile_versions.select("profile_version_id", F.col("version").alias("profile_version")),
              "profile_version_id")
        .join(roles, "profile_version_id", "left")
        .join(constraints.select("profile_version_id", "min_salary"), "profile_version_id")
        .join(moved(answer_numbers(profile_axis_values)), "profile_version_id")
    )
    if role is not None:
        rows = rows.where(F.array_contains("target_roles", role))
    carried = [c for c in rows.columns if not c.startswith(("answer_", "seen_"))]
    counted = axis_status_counts(
        compare_numbers(rows, carried), *[c for c in carried if c != "match_result_id"]).where(JUDGEMENTS[judgement]())
    # A posting counts as often as it has conditions, and once without any.
    stale_conditions = F.when(F.col("stale_rows").isNull(), F.array(F.lit(False))).otherwise(F.concat(
        F.array_repeat(F.col("min_salary").isNotNull(), F.col("stale_rows")),
        F.array_repeat(F.lit(False), F.col("other_rows"))))
    rows = (
        counted.withColumn("stale_condition", F.explode(stale_conditions))
        .withColumn("stale_conditions", F.col("stale_condition") | F.coalesce("is_stale", F.lit(False)))
        .withColumn("sort_count", SORTS[sort]().cast("bigint"))
    )
    place = ["sort_count", "analyzed_at", "match_result_id"]
    if after is not None:
        cursor = after.select("user_id", F.struct(*place).alias("cursor"))
        rows = rows.join(cursor, "user_id", "left").where(
            F.col("cursor").isNull() | (F.struct(*place) < F.col("cursor"))).drop("cursor")
    page = top_per_key(rows, ["user_id"], newest(*place), limit + 1, rank="page_row")
    company = companies.join(latest_evaluations(evaluations, "company", "company_id").select(
        "company_id", F.col("evaluation_id").alias("company_evaluation_id"),
        F.col("created_at").alias("company_evaluated_at")), "company_id", "left")
    return (
        page.join(postings.select("job_posting_id", F.col("title").alias("job_title")), "job_posting_id")
        .join(company, "company_id")
        .select("user_id", "page_row", "job_posting_id", "match_result_id", "analyzed_at",
                "profile_version_id", "profile_version", "target_roles", "job_title", "company_id",
                "company_name", F.col("evaluation_id").alias("job_evaluation_id"),
                "company_evaluation_id", "company_evaluated_at", "close_count", "different_count",
                "partial_count", "unknown_count", "stale_conditions", "sort_count")
    )


def saved_jobs(
    saved: DataFrame, evaluations: DataFrame, postings: DataFrame, companies: DataFrame, limit: int,
    after: DataFrame | None = None,
) -> DataFrame:
    """Saved postings newest first per user with the latest job and company evaluation."""
    if after is not None:
        place = F.struct("saved_at", "job_posting_id")
        saved = saved.join(after.select(
            "user_id", F.struct("saved_at", "job_posting_id").alias("cursor")), "user_id", "left"
        ).where(F.col("cursor").isNull() | (place < F.col("cursor"))).drop("cursor")
    page = top_per_key(saved, ["user_id"], newest("saved_at", "job_posting_id"), limit + 1, "page_row")
    job = latest_evaluations(evaluations, "job", "job_posting_id").select(
        "job_posting_id", F.col("evaluation_id").alias("job_evaluation_id"))
    company = latest_evaluations(evaluations, "company", "company_id").select(
        "company_id", F.col("evaluation_id").alias("company_evaluation_id"))
    return (
        page.join(postings.select("job_posting_id", "company_id", "title"), "job_posting_id")
        .join(companies, "company_id")
        .join(job, "job_posting_id", "left").join(company, "company_id", "left")
        .select("user_id", "page_row", "job_posting_id", "saved_at", "title", "company_name",
                "job_evaluation_id", "company_evaluation_id")
    )


def unmatched_evaluations(
    requests: DataFrame, jobs: DataFrame, matches: DataFrame, limit: int
) -> DataFrame:
    """Requested evaluations without a match, first per (time, url), at most ``limit`` per user."""
    wanted = requests.join(
        jobs.select("job_id", F.col("evaluation_id").alias("job_evaluation_id")), "job_id", "left"
    ).withColumn("evaluation_id", F.coalesce("job_evaluation_id", "requested_evaluation_id")) \
        .where("evaluation_id is not null")
    open_ = wanted.join(matches.select("user_id", "evaluation_id"), ["user_id", "evaluation_id"], "left_anti")
    first = top_per_key(open_, ["user_id", "requested_at", "url_id"], [F.col("evaluation_id").asc()])
    return top_per_key(
        first, ["user_id"], [F.col("requested_at").asc(), F.col("url_id").asc()], limit, "position"
    ).select("user_id", "position", "requested_at", "url_id", "evaluation_id")
