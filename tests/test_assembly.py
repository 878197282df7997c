"""Every document is judged, and a called model answers for every axis the rules left open."""

import pytest

from fitgrid.operators import facts
from fitgrid.plans.catalog import all_queries
from fitgrid.schemas import AXES, RAW_TABLES

QUERIES = all_queries()


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = [(key, f"name {key}", "Brand#1", "STANDARD", 10, 1.0) for key in (3, 4, 5, 9, 15)]
    spark.createDataFrame(rows, RAW_TABLES["part"]).write.parquet(f"{folder}/part.parquet")
    return folder


def test_the_model_is_called_for_every_document(spark, parts):
    rows = QUERIES["evaluation_assembly"](spark, parts).collect()
    assert sorted((r.document_id, r.axis_idx) for r in rows) == [(d, i) for d in (3, 4, 5, 9, 15) for i in range(8)]
    ruled = {"work_location", "schedule_flexibility"}
    assert {(r.axis_key in ruled, r.method) for r in rows} == {(True, "rule"), (False, "model")}


def test_every_third_document_has_judged_axes(spark, parts):
    got = {r.document_id: r for r in QUERIES["evaluation_quality"](spark, parts).collect()}
    # Document 3, autonomy: weights 23, 21 and 9 of 53, so 0 and 50 hold 0.83 of the judgement: a range.
    row = got[3]
    assert row.known_axes + row.range_axes + row.unknown_axes + row.conflicting_axes == 8
    assert row.range_axes > 0 and row.open_after_rules == 6


def test_a_called_model_answers_for_every_open_axis(spark):
    documents = spark.createDataFrame([(1, True), (2, False), (3, True), (None, None)], "document_id bigint, called boolean")
    rules = spark.createDataFrame(
        [(1, "work_location", "known", 50), (2, "work_location", "conflicting", None)],
        "document_id bigint, axis_key string, status string, anchor_value int")
    model = spark.createDataFrame(
        [(1, "autonomy", "range", 0, 50), (1, "work_location", "known", 100, None)],
        "document_id bigint, axis_key string, status string, anchor_value int, anchor_max int")
    got = {(r.document_id, r.axis_key): (r.status, r.anchor_value, r.anchor_max, r.method)
           for r in facts.assemble_evaluations(documents, rules, model).collect()}
    assert len(got) == 4 * len(AXES)
    assert got[1, "work_location"] == ("known", 50, None, "rule")
    assert got[1, "autonomy"] == ("range", 0, 50, "model")
    assert got[1, "collaboration"] == ("unknown", None, None, "model")
    assert got[2, "work_location"] == ("conflicting", None, None, "rule")
    assert got[2, "autonomy"] == ("unknown", None, None, "deterministic")
    assert {got[3, axis] for axis in AXES} == {("unknown", None, None, "model")}
    assert {got[None, axis] for axis in AXES} == {("unknown", None, None, "deterministic")}


def test_only_axes_the_rules_left_open_are_put_to_the_model(spark, parts, monkeypatch):
    asked, judge = [], facts.axis_judgements

    def seen(choices, evidence):
        asked.extend((r.document_id, r.axis_key) for r in choices.select("document_id", "axis_key").distinct().collect())
        return judge(choices, evidence)
    monkeypatch.setattr(facts, "axis_judgements", seen)
    rows = QUERIES["evaluation_assembly"](spark, parts).collect()
    assert sorted(asked) == sorted((r.document_id, r.axis_key) for r in rows if r.method != "rule") and asked


def test_texts_are_read_once_for_the_rules(spark, parts):
    plan = QUERIES["evaluation_assembly"](spark, parts)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan.lower() and "週2日出社" not in plan
