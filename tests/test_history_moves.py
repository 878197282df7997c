"""How often the rows of a history page move, and that repeated or missing conditions count as in a join."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from fitgrid.bindings import Domain
from fitgrid.operators import history
from fitgrid.plans.catalog import all_queries
from fitgrid.schemas import AXES
from test_scale import SMALL

QUERIES = all_queries()


@pytest.fixture
def by_shuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["analysis_history_page", "analysis_history_filtered"])
def test_matches_visit_every_key_once(spark, by_shuffle, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    moves = re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\), (\w+)", plan)
    by = [re.sub(r"#\d+L?", "", keys) for keys, why in moves if why == "ENSURE_REQUIREMENTS"]
    # The match rows alone: observations and sources are where their order lines were dealt to.
    assert by.count("evaluation_id") == 1
    assert "l_orderkey" not in by and not [keys for keys in by if "target_version" in keys]
    # Profiles, roles, salaries, answers and the owners of the matches, and the match rows.
    assert by.count("profile_version_id") == 6


@pytest.mark.parametrize("key", ["l_orderkey", "evaluation_id"])
def test_dealt_lines_give_the_same_tables(spark, key):
    plain, dealt = Domain(spark, SMALL), Domain(spark, SMALL).dealt_by(key)
    for name in ("evaluations", "evaluated_axis_values", "evaluation_sources", "match_results"):
        a, b = getattr(plain, name), getattr(dealt, name)
        assert a.columns == b.columns and a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_a_posting_counts_as_often_as_it_has_conditions(spark):
    day = dt.datetime(2024, 1, 1)
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)
    matches = table([(m, 7, 70 + m % 2, m, m, 1, day + dt.timedelta(days=m)) for m in (1, 2, 3, 4)],
                    "match_result_id bigint, user_id bigint, profile_version_id bigint, evaluation_id bigint, "
                    "job_posting_id bigint, company_id bigint, created_at timestamp_ntz")
    answers = table([(p, a, 50, 50) for p in (70, 71) for a in AXES],
                    "profile_version_id bigint, axis_key string, preference int, importance int")
    seen = table([(1, AXES[0], "known", 50, None), (2, AXES[1], "known", 100, None)],
                 "evaluation_id bigint, axis_key string, observation_status string, anchor_value int, anchor_max int")
    conditions = table(
        [(1, "stale"), (1, "known"), (2, "stale"), (3, "stale"), (3, "stale"), (None, "stale")],
        "job_posting_id bigint, salary_status string").select(
            "*", F.lit(1).alias("salary_minimum"), F.lit(2).alias("salary_maximum"),
            F.lit("JPY").alias("salary_currency"), F.lit("year").alias("salary_period"))
    rows = history.analysis_history(
        matches, table([], "evaluation_id bigint, target_type string, company_id bigint, created_at timestamp_ntz"),
        table([(70, 1), (71, 2)], "profile_version_id bigint, version bigint"), answers, seen,
        table([(70, 1, "x")], "profile_version_id bigint, role_order int, role_text string"),
        table([(p, f"t{p}") for p in (1, 2, 3, 4)], "job_posting_id bigint, title string"),
        table([(1, "c")], "company_id bigint, company_name string"),
        table([(4, day), (2, day + dt.timedelta(days=900))], "evaluation_id bigint, fetched_at timestamp_ntz"),
        table([(70, None), (71, 5)], "profile_version_id bigint, min_salary bigint"), conditions,
        F.lit("2025-01-01").cast("timestamp_ntz"), limit=20).collect()
    assert [r.page_row for r in sorted(rows, key=lambda r: r.page_row)] == [1, 2, 3, 4, 5, 6]
    got = sorted((r.match_result_id, r.stale_conditions) for r in rows)
    # 1 and 3 want a salary (profile 71); 4 rests on an old source and has no conditions.
    assert got == [(1, False), (1, True), (2, False), (3, True), (3, True), (4, True)]
    assert {(r.match_result_id, r.close_count, r.different_count, r.unknown_count) for r in rows} == {
        (1, 1, 0, 7), (2, 0, 1, 7), (3, 0, 0, 8), (4, 0, 0, 8)}
