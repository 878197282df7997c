"""Profiles against evaluations: axis comparison, hard constraints, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrid.functions.axes import axis_comparison, status_counts
from fitgrid.operators.keyed import moved, newest, top_per_key
from fitgrid.schemas import AXES


# Observation statuses by their number inside a packed value.
_STATUSES = ("unknown", "conflicting", "stale", "known", "range")


def _packed(df: DataFrame, key: str, value: Column, prefix: str) -> DataFrame:
    """One row per key with one whole number per axis.

    Numbers keep the aggregate in plain hash buffers: rows of a key that meet in
    a map task are folded there, and the shuffle carries eight numbers per key.
    """
    return df.groupBy(key).agg(*[
        F.max(F.when(F.col("axis_key") == axis, value)).alias(f"{prefix}{i}")
        for i, axis in enumerate(AXES)])


def _answer_number() -> Column:
    return F.col("preference") * 1000 + F.col("importance")


def _observation_number() -> Column:
    """Status, lower and upper anchor in three groups of digits; an absent anchor is 0."""
    status = F.array_position(F.array(*[F.lit(s) for s in _STATUSES]), F.col("observation_status"))
    def anchor(name):
        return F.coalesce(F.col(name) + 1, F.lit(0))
    return (status * 1_000_000 + anchor("anchor_value") * 1000 + anchor("anchor_max")).cast("int")


def answer_numbers(profile_axis_values: DataFrame) -> DataFrame:
    """One row per profile version with its eight answers."""
    return _packed(profile_axis_values, "profile_version_id", _answer_number(), "answer_")


def observation_numbers(evaluated_axis_values: DataFrame) -> DataFrame:
    """One row per evaluation with its eight observations."""
    return _packed(evaluated_axis_values, "evaluation_id", _observation_number(), "seen_")


def compare_axes(
    matches: DataFrame, profile_axis_values: DataFrame, evaluated_axis_values: DataFrame
) -> DataFrame:
    """Comparison row per (match, axis).

    Both axis tables are packed to one row per key, so the joins move matches
    and not eight rows per match; a popular evaluation or a busy profile makes
    a skewed but splittable equi-join. The eight rows appear after the joins.
    """
    rows = (
        matches.join(moved(answer_numbers(profile_axis_values)), "profile_version_id")
        .join(moved(observation_numbers(evaluated_axis_values)), "evaluation_id", "left"))
    return compare_numbers(rows, matches.columns)


def compare_numbers(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Comparison row per (row, axis) of rows that carry both sets of numbers."""
    slots = F.array(*[
        F.struct(F.lit(i).alias("axis_idx"), F.lit(axis).alias("axis_key"),
                 F.col(f"answer_{i}").alias("answer"), F.col(f"seen_{i}").alias("seen"))
        for i, axis in enumerate(AXES)])
    rows = rows.select(*carried, F.inline(slots)).where("answer is not null")
    seen = F.col("seen")
    def anchor(number):
        return F.when(number > 0, number - 1)
    number = F.expr("seen div 1000000")
    status = F.when(seen.isNull(), _STATUSES[0])
    for i, name in enumerate(_STATUSES, start=1):
        status = status.when(number == i, name)
    opened = rows.select(
        *carried, "axis_idx", "axis_key",
        F.expr("answer div 1000").cast("int").alias("preference"),
        (F.col("answer") % 1000).alias("importance"), status.alias("observation_status"),
        anchor(F.expr("seen div 1000 % 1000").cast("int")).alias("anchor_value"),
        anchor(seen % 1000).alias("anchor_max"))
    verdict = axis_comparison(*[F.col(c) for c in (
        "preference", "importance", "observation_status", "anchor_value", "anchor_max")])
    return opened.select("*", verdict.alias("verdict")).select("*", "verdict.*").drop("verdict")


def axis_status_counts(comparisons: DataFrame, *carried: str) -> DataFrame:
    """Counts per match, with columns that belong to the match carried along.

    The keys of the joins that made the comparisons are grouping keys too, so
    the rows are where they must be and the counting needs no shuffle of its own.
    """
    keys = [k for k in ("profile_version_id", "evaluation_id") if k in comparisons.columns and k not in carried]
    counted = comparisons.groupBy("match_result_id", *keys, *carried).agg(
        *status_counts(F.col("comparison_status")))
    return counted.drop(*keys)


def version_compatibility(pairs: DataFrame, evaluated_axis_values: DataFrame) -> DataFrame:
    """Comparable only if the target and each of its axis rows use the profile's catalog version."""
    versions = evaluated_axis_values.groupBy("evaluation_id").agg(
        F.min("axis_version").alias("lowest"), F.max("axis_version").alias("highest"))
    wanted = F.col("profile_catalog_version")
    mixed = ((F.col("target_version") != wanted)
             | F.coalesce((F.col("lowest") != wanted) | (F.col("highest") != wanted), F.lit(False)))
    return pairs.join(versions, "evaluation_id", "left").select(
        *pairs.columns,
        F.when(mixed, "incompatible").otherwise("comparable").alias("compatibility"),
        F.when(mixed, "axis_version_mismatch").alias("incompatible_reason"))


# Hard constraints ---------------------------------------------------------------------------

def _missing(status: Column) -> Column:
    return (F.when(status == "conflicting", "conflicting_information")
            .when(status == "stale", "stale_information").otherwise("missing_information"))


def _result(kind: str, *branches: tuple[Column, str, Column | str | None], default) -> Column:
    """``struct<kind, status, reason>`` of the first branch that holds."""
    status = reason = None
    for condition, verdict, why in branches:
        why = F.lit(None).cast("string") if why is None else F.lit(why) if isinstance(why, str) else why
        status = F.when(condition, verdict) if status is None else status.when(condition, verdict)
        reason = F.when(condition, why) if reason is None else reason.when(condition, why)
    verdict, why = default
    return F.struct(F.lit(kind).alias("kind"), status.otherwise(verdict).alias("status"),
                    reason.otherwise(F.lit(why)).alias("reason"))


def _known(status: str) -> Column:
    return F.coalesce(F.col(status), F.lit("unknown")) == "known"


def salary_result() -> Column:
    wanted = F.col("min_salary")
    other_unit = (F.col("salary_currency") != "JPY") | (F.col("salary_period") != "year")
    return _result(
        "min_salary",
        (wanted.isNull(), "not_required", None),
        (~_known("salary_status"), "unknown", _missing(F.col("salary_status"))),
        (other_unit, "unknown", "salary_unit_mismatch"),
        (F.col("salary_minimum") >= wanted, "met", None),
        (F.col("salary_maximum") < wanted, "unmet", "salary_below_minimum"),
        default=("unknown", "salary_range_overlaps_minimum"))


def stale_salaries(conditions: DataFrame) -> DataFrame:
    """Condition rows per posting: those on which a wanted salary rests on stale information, and the others.

    Whether it does is seen before the wanted amount is looked at, so any amount tells.
    """
    stale = F.coalesce(salary_result()["reason"] == "stale_information", F.lit(False))
    return conditions.withColumn("min_salary", F.lit(0)).groupBy("job_posting_id").agg(
        F.count_if(stale).cast("int").alias("stale_rows"), F.count_if(~stale).cast("int").alias("other_rows"))


def location_result() -> Column:
    allowed = F.col("allowed_prefectures")
    return _result(
        "location",
        (allowed.isNull(), "not_required", None),
        (~_known("location_status"), "unknown", _missing(F.col("location_status"))),
        (F.arrays_overlap(allowed, F.col("prefectures")), "met", None),
        default=("unmet", "location_outside_allowed"))


def remote_result() -> Column:
    return _result(
        "full_remote",
        (~F.col("full_remote_required"), "not_required", None),
        (~_known("remote_status"), "unknown", _missing(F.col("remote_status"))),
        (F.col("full_remote"), "met", None),
        default=("unmet", "regular_office_attendance_required"))


def constraint_inputs(matches: DataFrame, constraints: DataFrame, conditions: DataFrame) -> DataFrame:
    return matches.join(constraints, "profile_version_id").join(conditions, "job_posting_id", "left")


def constraint_rows(inputs: DataFrame, *results: Column) -> DataFrame:
    """Long form, one row per (match, constraint), in one pass over the joined inputs."""
    return inputs.select("match_result_id", F.inline(F.array(*results)))


def hard_constraints(matches: DataFrame, constraints: DataFrame, conditions: DataFrame) -> DataFrame:
    """Three results per match plus the match-level conflict flag, without an aggregate."""
    results = F.array(salary_result(), location_result(), remote_result())
    inputs = constraint_inputs(matches, constraints, conditions).select(
        "match_result_id", results.alias("results"))
    return inputs.select(
        "match_result_id",
        F.exists("results", lambda r: r["status"] == "unmet").alias("has_hard_conflict"),
        F.inline("results"))


def match_summary(
    matches: DataFrame, profile_axis_values: DataFrame, evaluated_axis_values: DataFrame,
    constraints: DataFrame, conditions: DataFrame,
) -> DataFrame:
    """Per match: status counts over the eight axes and whether a hard constraint is unmet."""
    conflict = F.exists(F.array(salary_result(), location_result(), remote_result()),
                        lambda r: r["status"] == "unmet")
    judged = constraint_inputs(matches, constraints, conditions).select(
        "match_result_id", "profile_version_id", "evaluation_id", conflict.alias("has_hard_conflict"))
    return axis_status_counts(
        compare_axes(judged, profile_axis_values, evaluated_axis_values), "has_hard_conflict")


# Company reference, batches, snapshots -------------------------------------------------------

def latest_evaluations(evaluations: DataFrame, target_type: str, key: str) -> DataFrame:
    """Newest evaluation per job or company target."""
    return top_per_key(
        evaluations.where(F.col("target_type") == target_type), [key],
        newest("created_at", "evaluation_id"))


def company_reference(
    matches: DataFrame, evaluations: DataFrame, profile_axis_values: DataFrame,
    evaluated_axis_values: DataFrame,
) -> DataFrame:
    """Comparison with the company's latest own evaluation, beside the job and never merged in."""
    company = latest_evaluations(evaluations, "company", "company_id").select(
        "company_id", F.col("evaluation_id").alias("company_evaluation_id"))
    pairs = matches.select("match_result_id", "profile_version_id", "company_id") \
        .join(company, "company_id") \
        .select("match_result_id", "profile_version_id", "company_id",
                F.col("company_evaluation_id").alias("evaluation_id"))
    return compare_axes(pairs, profile_axis_values, evaluated_axis_values)


def new_matches(
    latest_profiles: DataFrame, requested: DataFrame, stored: DataFrame, algorithm: str
) -> DataFrame:
    """Requested evaluations of each user's latest profile that have no stored match yet."""
    key = ["profile_version_id", "evaluation_id"]
    wanted = latest_profiles.select("user_id", "profile_version_id", "axis_catalog_version").join(
        requested, ["user_id", "axis_catalog_version"]).dropDuplicates(key)
    return wanted.join(stored.select(*key), key, "left_anti").withColumn(
        "algorithm_version", F.lit(algorithm))


def snapshot_mismatches(
    stored: DataFrame, profile_axis_values: DataFrame, evaluated_axis_values: DataFrame
) -> DataFrame:
    """Stored axis snapshots that no longer equal the answers or observations they came from.

    Each of the three sides meets the others as one row per match, evaluation or
    profile; a stored axis row then finds all rows of its axis, as a left join would.
    """
    def listed(rows: DataFrame, keys: list[str], name: str, *columns: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.collect_list(F.struct("axis_key", *columns)).alias(name))
    answers = listed(profile_axis_values, ["profile_version_id"], "answers", "preference", "importance")
    observed = listed(
        evaluated_axis_values, ["evaluation_id"], "observed", "observation_status", "anchor_value", "anchor_max")
    snapshots = listed(
        stored, ["match_result_id", "profile_version_id", "evaluation_id"], "snapshots",
        "preference", "importance", "observation_status", "anchor_value", "anchor_max")
    def now(name: str) -> Column:
        return F.explode_outer(F.filter(name, lambda n: n["axis_key"] == F.col("snapshot.axis_key")))
    joined = (
        snapshots.join(moved(observed), "evaluation_id", "left").join(moved(answers), "profile_version_id", "left")
        .select("match_result_id", "answers", "observed", F.explode("snapshots").alias("snapshot"))
        .select("match_result_id", "snapshot", "observed", now("answers").alias("answer"))
        .select("match_result_id", "snapshot", "answer", now("observed").alias("seen"))
    )
    same_answer = (F.col("snapshot.preference").eqNullSafe(F.col("answer.preference"))
                   & F.col("snapshot.importance").eqNullSafe(F.col("answer.importance")))
    same_observation = (
        F.col("snapshot.observation_status").eqNullSafe(F.coalesce("seen.observation_status", F.lit("unknown")))
        & F.col("snapshot.anchor_value").eqNullSafe(F.col("seen.anchor_value"))
        & F.col("snapshot.anchor_max").eqNullSafe(F.col("seen.anchor_max")))
    return joined.where(~(same_answer & same_observation)).select(
        "match_result_id", F.col("snapshot.axis_key").alias("axis_key"), (~same_answer).alias("answer_differs"),
        (~same_observation).alias("observation_differs"))


def match_reports(
    comparisons: DataFrame, evidence: DataFrame, constraint_results: DataFrame, overview: DataFrame,
    write_axes: Callable[[Column], Column] = lambda axes: axes,
    write_constraints: Callable[[Column], Column] = lambda constraints: constraints,
) -> DataFrame:
    """Nested report per match: axes in catalog order with evidence, constraints in fixed order.

    Axis rows are put together where the comparison left them, by the evaluation
    of their match, and meet the evidence of the evaluation as one row. What
    ``write_axes`` and ``write_constraints`` make of the two lists is made before
    the rows move on to the match, so a short form moves as a short form.
    """
    cited = evidence.groupBy("evaluation_id").agg(
        F.collect_list(F.struct("axis_key", "locator", "excerpt")).alias("cited"))
    plain = comparisons.groupBy("match_result_id", "evaluation_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "axis_idx", "axis_key", "comparison_status", "difference", "difference_max"))).alias("axes"),
        F.first("job_posting_id").alias("job_posting_id"))
    def of(axis: Column) -> Column:
        own = F.filter(F.coalesce("cited", F.array().cast("array<struct<axis_key:string,locator:string,excerpt:string>>")),
                       lambda e: e["axis_key"] == axis["axis_key"])
        return F.sort_array(F.transform(own, lambda e: F.struct(e["locator"].alias("locator"), e["excerpt"].alias("excerpt"))))
    fields = ("axis_idx", "axis_key", "comparison_status", "difference", "difference_max")
    axes = plain.join(moved(cited), "evaluation_id", "left").select(
        "match_result_id", "job_posting_id",
        write_axes(F.transform("axes", lambda a: F.struct(
            *[a[f].alias(f) for f in fields], of(a).alias("evidence")))).alias("axes"))
    order = F.array_position(
        F.array(*[F.lit(k) for k in ("min_salary", "location", "full_remote")]), F.col("kind"))
    constraints = constraint_results.groupBy("match_result_id").agg(
        write_constraints(F.sort_array(F.collect_list(F.struct(order.alias("n"), "kind", "status", "reason"))))
        .alias("constraints"))
    return axes.join(constraints, "match_result_id").join(overview, "job_posting_id", "left")


# Shares --------------------------------------------------------------------------------------

def share_projections(comparisons: DataFrame, names: DataFrame) -> DataFrame:
    """The only publishable part of a match: names, time and eight statuses in catalog order."""
    # A match has one evaluation, and the comparison left its rows there: grouped by both they need not move.
    keys = [k for k in ("match_result_id", "evaluation_id") if k in comparisons.columns]
    axes = comparisons.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("axis_idx", "axis_key", "comparison_status"))),
            lambda a: F.struct(a["axis_key"].alias("axis_key"), a["comparison_status"].alias("status")),
        ).alias("axes"))
    return names.join(
        axes.where(F.size("axes") == len(AXES)).select("match_result_id", "axes"), "match_result_id")


def share_summaries(projections: DataFrame) -> DataFrame:
    """Counts and the first three close axes, from the public projection alone."""
    def count(*statuses: str) -> Column:
        return F.size(F.filter("axes", lambda a: a["status"].isin(*statuses)))
    close = F.transform(F.filter("axes", lambda a: a["status"] == "close"), lambda a: a["axis_key"])
    return projections.select(
        "match_result_id", count("close").alias("close"), count("different").alias("different"),
        count("partial").alias("partial"),
        count("unknown", "conflicting", "stale").alias("unknown"),
        F.slice(close, 1, 3).alias("close_axes"))
