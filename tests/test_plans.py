"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from fitgrid.plans.catalog import all_queries

SMALL = "/root/testdata/sf0.001"
QUERIES = all_queries()
PURE = [
    "axis_comparison", "axis_range_comparison", "version_compatibility", "hard_constraints", "match_summary",
    "analysis_history_page", "unmatched_evaluations", "daily_active_users", "consent_rate", "unknown_rate_daily",
    "company_interest_daily", "cohort_axis_distribution", "abuse_user_summary", "redact_text", "fact_reduction",
    "salary_facts", "rule_axis_decisions", "axis_judgement", "canonical_urls", "content_duplicates",
]


def plan(spark, name):
    df = QUERIES[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_core_queries_stay_in_the_engine(spark, name):
    text = plan(spark, name)
    for word in ("EvalPython", "InPandas", "CartesianProduct"):
        assert word not in text


@pytest.mark.parametrize("name", [
    "latest_match_per_job", "latest_evaluation", "latest_completed_profile", "consented_users", "saved_jobs_page",
    "analysis_history_page", "unmatched_evaluations", "evidence_top_k", "legal_history", "upsert_latest_request", "rank_candidates"])
def test_top_rows_are_cut_down_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_large_budgets_are_cut_down_too(spark):
    text = plan(spark, "daily_budget")
    assert text.count("WindowGroupLimit") >= 2


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "analysis_usage_daily")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


def test_counting_statuses_needs_no_shuffle_after_the_joins(spark):
    """With joins by shuffle, the counts use the place the last join gave the rows."""
    from fitgrid.bindings import Domain
    from fitgrid.operators import matching
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = Domain(spark, SMALL)
        matches = d.evaluations.select(
            F.col("evaluation_id").alias("match_result_id"), F.col("l_orderkey").alias("profile_version_id"), "evaluation_id")
        compared = matching.compare_axes(matches, d.profile_axis_values, d.evaluated_axis_values)
        def shuffles(df):
            return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert shuffles(matching.axis_status_counts(compared)) == shuffles(compared)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["known_postings_search", "same_company_pairs"])
def test_substring_joins_are_equal_joins_on_pieces(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "CartesianProduct" not in text
