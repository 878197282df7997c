"""Daily, cohort and abuse aggregates; job state sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrid.bindings import tokyo_day
from fitgrid.functions.axes import tenths
from fitgrid.operators.history import latest_completed_profiles
from fitgrid.operators.keyed import moved, split_running_sum
from fitgrid.schemas import MIN_COHORT


def daily_active_users(*sources: DataFrame) -> DataFrame:
    """Distinct users per Tokyo day over several (user_id, at) sources."""
    rows = None
    for source in sources:
        part = source.select("user_id", tokyo_day(F.col("at")).alias("day"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("day").agg(F.count_distinct("user_id").alias("active_users"))


def usage_daily(events: DataFrame) -> DataFrame:
    return events.groupBy(tokyo_day(F.col("ts")).alias("day")).agg(
        F.count("*").alias("new_analyses"), F.count_distinct("user_id").alias("users"))


def unknown_rate_daily(evaluations: DataFrame, values: DataFrame) -> DataFrame:
    """Evaluated and unknown-or-conflicting axis values per day and axis."""
    day = evaluations.select("evaluation_id", tokyo_day(F.col("created_at")).alias("day"))
    unknown = F.count_if(F.col("observation_status").isin("unknown", "conflicting"))
    return (
        values.select("evaluation_id", "axis_key", "observation_status").join(day, "evaluation_id")
        .groupBy("day", "axis_key").agg(F.count("*").alias("evaluated"), unknown.alias("unknown"))
        .withColumn("unknown_percent", tenths(F.col("unknown") * 100, F.col("evaluated")))
    )


def unknown_ratio(evaluations: DataFrame, values: DataFrame, start: Column, end: Column) -> DataFrame:
    """Share of unknown axis values per month of a time range, in thousandths."""
    day = evaluations.where((F.col("created_at") >= start) & (F.col("created_at") < end)).select(
        "evaluation_id", F.date_format("created_at", "yyyy-MM").alias("month"))
    return values.join(day, "evaluation_id").groupBy("month").agg(
        F.count_if(F.col("observation_status") == "unknown").alias("unknown_axes"),
        F.count("*").alias("all_axes"),
    ).withColumn("unknown_share", F.try_divide("unknown_axes", "all_axes"))


def evaluator_usage_daily(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy(tokyo_day(F.col("created_at")).alias("day"), "evaluator_version").agg(
        F.count("*").alias("evaluations"))


def company_interest_daily(
    interest: DataFrame, consented: DataFrame, companies: DataFrame, minimum: int = MIN_COHORT
) -> DataFrame:
    """Consented distinct users per day and company name; small groups are dropped.

    Counted per company id first. Several companies may carry one name, so the
    distinct (day, name, user) rows are formed after the name is known.
    """
    agreed = consented.where("purpose = 'community_benchmark'").select("user_id")
    seen = (
        interest.join(agreed, "user_id", "left_semi")
        .select(tokyo_day(F.col("created_at")).alias("day"), "company_id", "user_id").distinct()
    )
    return (
        seen.join(companies, "company_id").groupBy("day", "company_name")
        .agg(F.count_distinct("user_id").alias("users")).where(F.col("users") >= minimum)
    )


def cohort_axis_distribution(
    consented: DataFrame, educations: DataFrame, profile_versions: DataFrame,
    profile_axis_values: DataFrame, minimum: int = MIN_COHORT,
) -> DataFrame:
    """Average answers per graduation year and axis from latest completed profiles of consenting users."""
    agreed = consented.where("purpose = 'community_benchmark'").select("user_id")
    years = educations.join(agreed, "user_id", "left_semi").groupBy("user_id").agg(
        F.max(F.year("ended_on")).alias("graduation_year"))
    latest = latest_completed_profiles(profile_versions.join(agreed, "user_id", "left_semi")).select(
        "user_id", "profile_version_id", "axis_catalog_version")
    members = years.join(latest, "user_id")
    return (
        moved(profile_axis_values).join(members, "profile_version_id")
        .groupBy("graduation_year", "axis_catalog_version", "axis_key")
        .agg(F.count("*").alias("users"), F.sum("preference").alias("p"), F.sum("importance").alias("i"))
        .where(F.col("users") >= minimum)
        .select("graduation_year", "axis_catalog_version", "axis_key", "users",
                tenths(F.col("p"), F.col("users")).alias("avg_preference"),
                tenths(F.col("i"), F.col("users")).alias("avg_importance"))
    )


def abuse_overview(events: DataFrame, since: Column) -> DataFrame:
    """Events, users and the widest shared ip key per event type."""
    recent = events.where(F.col("ts") >= since)
    shared = (
        recent.where("ip_key is not null").groupBy("event_type", "ip_key")
        .agg(F.count_distinct("user_id").alias("n"))
        .groupBy("event_type").agg(F.max("n").alias("n"))
    )
    return recent.groupBy("event_type").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users")
    ).join(shared, "event_type", "left").select(
        "event_type", "events", "users", F.coalesce("n", F.lit(0)).alias("max_users_per_ip_key"))


def abuse_users(events: DataFrame, failed_jobs: DataFrame, since: Column) -> DataFrame:
    """Signals per user, widest sharing first.

    Events shrink to distinct (user, key) pairs before the key widths join back,
    so a key shared by very many events moves one row per user.
    """
    recent = events.where(F.col("ts") >= since)
    def of(kind: str) -> Column:
        return F.count_if(F.col("event_type") == kind)
    counts = recent.groupBy("user_id").agg(
        of("analysis_new").alias("new_analyses"), of("analysis_cached").alias("cached_requests"),
        of("analysis_quota_rejected").alias("quota_rejections"),
        of("analysis_rate_limited").alias("rate_limited"),
        of("career_profile_saved").alias("profile_saves"), of("share_created").alias("shares_created"),
        F.count_distinct("ua_key").alias("distinct_ua_keys"))
    pairs = recent.where("ip_key is not null").select("user_id", "ip_key").distinct()
    widths = pairs.groupBy("ip_key").agg(F.count("*").alias("width"))
    keys = pairs.join(widths, "ip_key").groupBy("user_id").agg(
        F.count("*").alias("distinct_ip_keys"), F.max("width").alias("max_users_sharing_ip_key"))
    failed = failed_jobs.groupBy("user_id").agg(F.count("*").alias("failed_jobs"))
    zero = ["distinct_ip_keys", "max_users_sharing_ip_key", "failed_jobs"]
    return (
        counts.join(keys, "user_id", "left").join(failed, "user_id", "left").fillna(0, zero)
        .orderBy(F.desc("max_users_sharing_ip_key"),
                 F.desc(F.col("rate_limited") + F.col("quota_rejections")),
                 F.desc("new_analyses"), "user_id")
    )


def job_backlog(runs: DataFrame) -> DataFrame:
    """Waiting jobs, and running jobs whose lease has expired, right after every instant at which a count changes.

    ``runs`` has one row per job: ``queued_at, leased_at, lease_until, ended_at``.
    A job waits from ``queued_at`` until it is leased, or ends without a lease. A
    leased job counts as expired from ``lease_until`` until it ends; one that ends
    in time never does. A missing instant has not come yet; a job that leaves no
    later than it enters is never counted.

    Result: ``series, instant, entered, left, open_jobs``. Both ends of an interval are
    events; equal instants are added up before the running sum, which goes month
    by month.
    """
    waiting = F.struct(F.lit("queued").alias("series"), F.col("queued_at").alias("since"),
                       F.coalesce("leased_at", "ended_at").alias("until"))
    expired = F.struct(F.lit("expired_lease").alias("series"),
                       F.when(F.col("leased_at").isNotNull(), F.col("lease_until")).alias("since"), F.col("ended_at").alias("until"))
    open_ = runs.select(F.inline(F.array(waiting, expired))).where("since is not null and (until is null or until > since)")
    ends = open_.select("series", F.inline(F.array(
        F.struct(F.col("since").alias("instant"), F.lit(1).alias("entered"), F.lit(0).alias("left")),
        F.struct(F.col("until").alias("instant"), F.lit(0).alias("entered"), F.lit(1).alias("left"))))).where("instant is not null")
    changes = ends.groupBy("series", "instant").agg(F.sum("entered").alias("entered"), F.sum("left").alias("left"))
    return split_running_sum(
        changes.withColumn("month", F.trunc(F.col("instant").cast("date"), "month")), ["series"], "month", ["instant"],
        F.col("entered") - F.col("left"), "open_jobs").select("series", "instant", "entered", "left", "open_jobs")


def job_transitions(jobs: DataFrame, now: Column, max_attempts: int) -> DataFrame:
    """Counts per (status, next status) of one sweep over the job table."""
    spent = F.col("attempts") >= max_attempts
    expired = (F.col("status") == "running") & (
        F.col("lease_until").isNull() | (F.col("lease_until") <= now))
    after = (F.when(expired & spent, "failed").when(expired, "queued")
             .when((F.col("status") == "queued") & spent, "failed").otherwise(F.col("status")))
    return jobs.groupBy("status", after.alias("next_status")).agg(F.count("*").alias("jobs"))
