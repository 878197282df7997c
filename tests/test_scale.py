"""Long tables are not sent through the driver, and work is dealt by rows."""

import re

import pytest
from pyspark.sql import functions as F

from fitgrid.bindings import Domain
from fitgrid.operators import facts, matching
from fitgrid.plans.catalog import all_queries
from fitgrid.schemas import AXES
from fitgrid.sources.tables import spread

SMALL = "/root/testdata/sf0.001"
QUERIES = all_queries()


def broadcast_parts(df):
    """The subtree below every broadcast of a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:|]*", line).group()) for line in lines]
    parts = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            parts.append("\n".join(lines[i:end]))
    return parts


@pytest.mark.parametrize("name", [
    "cohort_axis_distribution", "evaluation_assembly", "evaluation_payload_audit", "evaluation_quality",
    "match_snapshot_mismatch", "profile_revisions", "profile_audit", "axis_judgement", "fact_reduction"])
def test_opened_rows_are_never_broadcast(spark, name):
    for part in broadcast_parts(QUERIES[name](spark, SMALL)):
        assert "Generate inline" not in part


def test_pieces_are_bounded_by_rows(spark):
    table = spark.range(0, 1000, 1, 8)
    assert spread(table, "id").rdd.getNumPartitions() == 8
    assert spread(table, "id", piece=50).rdd.getNumPartitions() == 20
    assert spread(table, "id", piece=50).count() == 1000


@pytest.mark.parametrize("name", [
    "evidence_top_k", "axis_judgement", "fact_reduction", "page_fragments", "page_identity", "verify_postings"])
def test_parts_are_dealt_by_rows(spark, monkeypatch, name):
    monkeypatch.setattr("fitgrid.bindings.PART_PIECE", 10)  # 200 parts
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(p_partkey#\d+L, 20\), REPARTITION_BY_NUM", plan)


def test_axis_rows_stay_where_the_comparison_left_them(spark):
    """The last join is by evaluation; putting a match's axes together moves no axis rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("share_projection", "share_summary", "match_report"):
            plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"Exchange hashpartitioning\([^)]*axis_key", plan), name
            partial = re.findall(r"partial_collect_list\(struct\(axis_idx[^\n]*\n[^\n]*", plan)
            assert "Exchange" not in "".join(partial)
            final = re.findall(r"(?<!partial_)collect_list\(struct\(axis_idx[^\n]*\n([^\n]*)", plan)
            assert final and all("Exchange" not in line for line in final), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_report_gives_every_axis_its_own_evidence_in_order(spark):
    compared = spark.createDataFrame(
        [(1, 10, 5, i, a, "close", 3, None) for i, a in enumerate(AXES[:2])] * 2,
        "match_result_id bigint, evaluation_id bigint, job_posting_id bigint, axis_idx int, axis_key string, "
        "comparison_status string, difference int, difference_max int")
    evidence = spark.createDataFrame(
        [(10, AXES[1], "b", "x"), (10, AXES[1], "a", "y"), (10, None, "c", "z"), (11, AXES[0], "d", "w")],
        "evaluation_id bigint, axis_key string, locator string, excerpt string")
    results = spark.createDataFrame(
        [(1, "location", "met", None), (1, "min_salary", "unmet", "r")],
        "match_result_id bigint, kind string, status string, reason string")
    titles = spark.createDataFrame([(5, "T")], "job_posting_id bigint, title string")
    row = matching.match_reports(compared, evidence, results, titles).first()
    assert [a.axis_key for a in row.axes] == [AXES[0], AXES[0], AXES[1], AXES[1]]
    assert [[(e.locator, e.excerpt) for e in a.evidence] for a in row.axes] == [[], [], [("a", "y"), ("b", "x")], [("a", "y"), ("b", "x")]]
    assert [c.kind for c in row.constraints] == ["min_salary", "location"] and row.title == "T"
    short = matching.match_reports(
        compared, evidence, results, titles, lambda a: F.size(a), lambda c: F.size(c)).first()
    assert (short.axes, short.constraints) == (4, 2)


def test_hashes_taken_after_the_move_are_the_same(spark):
    rows = spark.createDataFrame(
        [(1, "b"), (1, "a"), (1, "b"), (1, None), (2, None), (None, "a")], "evaluation_id bigint, day string")
    before = facts.source_set_hashes(rows.select("evaluation_id", F.sha2("day", 256).alias("content_hash")))
    after = facts.source_set_hashes(rows, "day", lambda c: F.sha2(c, 256))
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_moved_sources_carry_the_day_and_not_its_hash(spark):
    plan = QUERIES["source_set_hash"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_set(day" in plan


def test_history_carries_only_the_constraint_it_reads(spark):
    plan = QUERIES["analysis_history_page"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "allowed_prefectures" not in plan and "full_remote_required" not in plan


def test_snapshots_meet_every_row_of_their_axis(spark):
    """Repeated and missing answers and observations count as in a left join."""
    stored = spark.createDataFrame(
        [(1, 5, 10, "a", 50, 25, "known", 0, None), (1, 5, 10, "b", 50, 25, "unknown", None, None),
         (2, 6, 11, "a", 50, 25, "unknown", None, None), (2, 6, 11, None, 50, 25, "unknown", None, None)],
        "match_result_id bigint, profile_version_id bigint, evaluation_id bigint, axis_key string, preference int, "
        "importance int, observation_status string, anchor_value int, anchor_max int")
    answers = spark.createDataFrame(
        [(5, "a", 50, 25), (5, "a", 51, 25), (5, "b", 50, 25), (6, None, 50, 25)],
        "profile_version_id bigint, axis_key string, preference int, importance int")
    seen = spark.createDataFrame(
        [(10, "a", "known", 0, None), (10, "a", "stale", 50, None)],
        "evaluation_id bigint, axis_key string, observation_status string, anchor_value int, anchor_max int")
    rows = matching.snapshot_mismatches(stored, answers, seen).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        (1, "a", False, True), (1, "a", True, False), (1, "a", True, True),
        (2, "a", True, False), (2, None, True, False)], key=str)


def test_snapshots_move_as_one_row_a_match(spark):
    plan = QUERIES["match_snapshot_mismatch"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*axis_key", plan)


def test_shares_with_axes_or_statuses_of_their_own_are_kept(spark):
    rows = [(m, i, f"{a}!" if m == 2 else a, "odd" if m == 3 else None if m == 4 else "partial")
            for m in (1, 2, 3, 4) for i, a in enumerate(AXES)]
    comparisons = spark.createDataFrame(
        rows, "match_result_id bigint, axis_idx int, axis_key string, comparison_status string")
    names = spark.createDataFrame([(m, "C") for m in (1, 2, 3, 4)], "match_result_id bigint, company_name string")
    got = {r.match_result_id: [tuple(a) for a in r.axes] for r in matching.share_projections(comparisons, names).collect()}
    assert got == {m: [(k, s) for n, _, k, s in rows if n == m] for m in (1, 2, 3, 4)}


@pytest.mark.parametrize("name", [
    "rank_candidates", "candidate_selector", "resolution_decision", "registry_site_match", "official_sites"])
def test_names_are_folded_once_in_a_task(spark, monkeypatch, name):
    """Every evaluation in Python takes a worker of its own in each running task."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df
    monkeypatch.setattr("fitgrid.plans.resolve.checkpointed", seen)
    seen(QUERIES[name](spark, SMALL))
    for lines in (plan.splitlines() for plan in plans):
        found = [(i, line.index("ArrowEvalPython")) for i, line in enumerate(lines) if "ArrowEvalPython" in line]
        assert found
        for i, depth in found:
            for line in lines[i + 1:]:  # down to the next shuffle, which begins another task
                at = re.search(r"[A-Z]", line).start()
                if at <= depth or "Exchange" in line:
                    break
                assert "ArrowEvalPython" not in line, name
