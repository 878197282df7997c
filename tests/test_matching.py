"""Boundary cases of axis comparison, hard constraints and shares, as literal rows."""

import pytest
from pyspark.sql import functions as F

from fitgrid.functions.axes import axis_comparison
from fitgrid.operators import matching
from fitgrid.schemas import AXES


@pytest.mark.parametrize("preference, importance, status, low, high, expected", [
    (75, 50, "known", 50, None, ("close", 25, None)),
    (76, 50, "known", 50, None, ("different", 26, None)),
    (75, 50, "range", 50, 100, ("close", 25, 25)),
    (100, 50, "range", 50, 100, ("partial", 0, 50)),
    (30, 50, "range", 50, 100, ("partial", 20, 70)),
    (24, 50, "range", 50, 100, ("different", 26, 76)),
    (25, 50, "range", 50, 100, ("partial", 25, 75)),
    (50, 0, "known", 50, None, ("excluded", None, None)),
    (50, 0, "range", 50, 100, ("excluded", None, None)),
    (50, 50, "unknown", None, None, ("unknown", None, None)),
    (50, 50, "conflicting", None, None, ("conflicting", None, None)),
    (50, 50, "stale", 50, None, ("stale", None, None)),
    (50, 50, None, None, None, ("unknown", None, None)),
])
def test_axis_boundaries(spark, preference, importance, status, low, high, expected):
    row = spark.createDataFrame(
        [(preference, importance, status, low, high)], "p int, i int, s string, a int, b int"
    ).select(axis_comparison(*[F.col(c) for c in "pisab"]).alias("v")).first().v
    assert tuple(row) == expected


def _profile(spark, value=50):
    return spark.createDataFrame(
        [(1, a, value, 100) for a in AXES], "profile_version_id bigint, axis_key string, preference int, importance int")


def _observed(spark, rows):
    return spark.createDataFrame(
        rows, "evaluation_id bigint, axis_key string, observation_status string, anchor_value int, anchor_max int")


def _match(spark):
    return spark.createDataFrame(
        [(7, 1, 10)], "match_result_id bigint, profile_version_id bigint, evaluation_id bigint")


def test_missing_axes_stay_unknown_and_are_never_a_number(spark):
    observed = _observed(spark, [(10, "autonomy", "known", 50, None), (10, "work_change", "stale", 50, None)])
    rows = matching.compare_axes(_match(spark), _profile(spark), observed).collect()
    by_axis = {r.axis_key: r for r in rows}
    assert len(rows) == 8 and by_axis["autonomy"].comparison_status == "close"
    assert by_axis["work_change"].comparison_status == "stale" and by_axis["work_change"].difference is None
    unknown = [r for r in rows if r.comparison_status == "unknown"]
    assert len(unknown) == 6 and all(r.difference is None for r in unknown)


def test_an_evaluation_without_any_axis_row_is_all_unknown(spark):
    rows = matching.compare_axes(_match(spark), _profile(spark), _observed(spark, [(99, "autonomy", "known", 0, None)]))
    counts = matching.axis_status_counts(rows).first()
    assert (counts.close_count, counts.different_count, counts.partial_count, counts.unknown_count) == (0, 0, 0, 8)


def test_rows_of_others_change_nothing(spark):
    observed = _observed(spark, [(10, "autonomy", "known", 100, None)])
    more = observed.unionByName(_observed(spark, [(11, a, "known", 0, None) for a in AXES]))
    first = matching.compare_axes(_match(spark), _profile(spark), observed)
    second = matching.compare_axes(_match(spark), _profile(spark), more.repartition(5))
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


CONSTRAINTS = ("match_result_id bigint, min_salary bigint, allowed_prefectures array<string>, "
               "full_remote_required boolean, salary_status string, salary_minimum bigint, salary_maximum bigint, "
               "salary_currency string, salary_period string, location_status string, prefectures array<string>, "
               "remote_status string, full_remote boolean")


@pytest.mark.parametrize("row, salary, location, remote", [
    ((None, None, False, "known", 1, 2, "JPY", "year", "known", ["13"], "known", True),
     ("not_required", None), ("not_required", None), ("not_required", None)),
    ((500, ["13"], True, "known", 500, 900, "JPY", "year", "known", ["27", "13"], "known", True),
     ("met", None), ("met", None), ("met", None)),
    ((500, ["13"], True, "known", 400, 499, "JPY", "year", "known", ["27"], "known", False),
     ("unmet", "salary_below_minimum"), ("unmet", "location_outside_allowed"),
     ("unmet", "regular_office_attendance_required")),
    ((500, ["13"], True, "known", 400, 500, "JPY", "year", "unknown", None, "conflicting", None),
     ("unknown", "salary_range_overlaps_minimum"), ("unknown", "missing_information"),
     ("unknown", "conflicting_information")),
    ((500, ["13"], True, "known", 900, 999, "USD", "year", "stale", ["13"], None, None),
     ("unknown", "salary_unit_mismatch"), ("unknown", "stale_information"), ("unknown", "missing_information")),
    ((500, ["13"], True, "known", 900, 999, "JPY", "month", "conflicting", None, "stale", True),
     ("unknown", "salary_unit_mismatch"), ("unknown", "conflicting_information"), ("unknown", "stale_information")),
])
def test_hard_constraints(spark, row, salary, location, remote):
    df = spark.createDataFrame([(1, *row)], CONSTRAINTS)
    rows = matching.constraint_rows(
        df, matching.salary_result(), matching.location_result(), matching.remote_result()).collect()
    assert [(r.status, r.reason) for r in rows] == [salary, location, remote]


def test_catalog_versions_must_agree(spark):
    pairs = spark.createDataFrame(
        [(1, 10, 1, 1), (2, 11, 1, 2), (3, 12, 1, 1), (4, 13, 1, 1)],
        "match_result_id bigint, evaluation_id bigint, profile_catalog_version int, target_version int")
    values = spark.createDataFrame([(10, 1), (10, 1), (11, 1), (12, 1), (12, 2)], "evaluation_id bigint, axis_version int")
    rows = {r.match_result_id: r.compatibility for r in matching.version_compatibility(pairs, values).collect()}
    assert rows == {1: "comparable", 2: "incompatible", 3: "incompatible", 4: "comparable"}


def test_share_summary_lists_three_close_axes_in_catalog_order(spark):
    comparisons = _match(spark).select("match_result_id").crossJoin(spark.createDataFrame(
        [(i, a, "close" if i % 2 == 0 else "stale") for i, a in enumerate(AXES)],
        "axis_idx int, axis_key string, comparison_status string"))
    names = spark.createDataFrame([(7, "C", "T")], "match_result_id bigint, company_name string, job_title string")
    projected = matching.share_projections(comparisons, names)
    assert set(projected.columns) == {"match_result_id", "company_name", "job_title", "axes"}
    summary = matching.share_summaries(projected).first()
    assert (summary.close, summary.unknown, summary.close_axes) == (4, 4, [AXES[0], AXES[2], AXES[4]])
    assert matching.share_projections(comparisons.where("axis_idx > 0"), names).isEmpty()
