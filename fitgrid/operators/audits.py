"""Rule checks over whole tables: one row per violation, or counts per rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrid.operators.keyed import moved
from fitgrid.schemas import AXES


def _violations(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    named = F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return rows.select(key, F.explode(named).alias("rule"))


def profile_audit(
    versions: DataFrame, axis_values: DataFrame, roles: DataFrame, constraints: DataFrame
) -> DataFrame:
    """Broken rules of completed profile versions."""
    key = "profile_version_id"
    axes = axis_values.groupBy(key).agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.when(F.col("axis_key").isin(*AXES), F.col("axis_key"))).alias("axes"),
        F.min("axis_version").alias("low_version"), F.max("axis_version").alias("high_version"),
        F.bool_or(~F.col("preference").between(0, 100) | ~F.col("importance").between(0, 100)).alias("off_scale"))
    text = F.trim("role_text")
    named = roles.groupBy(key).agg(
        F.count("*").alias("roles"), F.count_distinct(text).alias("distinct_roles"),
        F.bool_or(text == "").alias("blank_role"))
    rows = (
        versions.where("status = 'completed'").join(moved(axes), key, "left").join(moved(named), key, "left")
        .join(moved(constraints), key, "left")
    )
    codes = F.col("allowed_prefectures")
    return _violations(rows, key, {
        "axes_incomplete": (F.coalesce("axes", F.lit(0)) != 8) | (F.coalesce("rows", F.lit(0)) != 8),
        "axis_versions_mixed": (F.col("low_version") != F.col("axis_catalog_version"))
        | (F.col("high_version") != F.col("axis_catalog_version")),
        "axis_value_off_scale": F.col("off_scale"),
        "role_missing": F.col("roles").isNull(),
        "role_blank": F.col("blank_role"),
        "role_repeated": F.col("distinct_roles") < F.col("roles"),
        "salary_not_positive": F.col("min_salary") < 1,
        "prefecture_repeated": F.size(F.array_distinct(codes)) < F.size(codes),
        "prefecture_unknown": F.exists(codes, lambda c: ~c.rlike("^(?:0[1-9]|[1-3][0-9]|4[0-7])$")),
    })


def rule_counts(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule in one pass over the rows."""
    counted = rows.agg(*[F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in rules.items()])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])))


def missing_parents(children: DataFrame, parents: DataFrame, key: str, rule: str) -> DataFrame:
    return children.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti").agg(
        F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def repeated_keys(rows: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Keys held by more than one row."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(
        F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def axis_value_rules() -> dict[str, Column]:
    """An anchor exists exactly where its status asks for one, and a range spans two neighbours."""
    status, low, high = F.col("observation_status"), F.col("anchor_value"), F.col("anchor_max")
    return {
        "anchor_without_value": status.isin("known", "stale", "range") & low.isNull(),
        "value_without_status": status.isin("unknown", "conflicting") & low.isNotNull(),
        "range_without_maximum": (status == "range") & (high.isNull() | (high - low != 50)),
        "maximum_without_range": (status != "range") & high.isNotNull(),
        "anchor_not_documented": low.isNotNull() & ~low.isin(0, 50, 100),
    }


def comparison_rules() -> dict[str, Column]:
    status, gap = F.col("comparison_status"), F.col("difference")
    return {
        "close_beyond_limit": (status == "close") & (F.coalesce("difference_max", "difference") > 25),
        "different_within_limit": (status == "different") & (gap <= 25),
        "difference_without_value": status.isin("unknown", "conflicting", "stale", "excluded") & gap.isNotNull(),
    }


def constraint_rules() -> dict[str, Column]:
    status, reason = F.col("status"), F.col("reason")
    return {
        "reason_without_need": status.isin("met", "not_required") & reason.isNotNull(),
        "reason_missing": status.isin("unmet", "unknown") & reason.isNull(),
    }


def payload_audit(axis_rows: DataFrame, evidence: DataFrame, fragments: DataFrame) -> DataFrame:
    """Broken rules of evaluation payloads, one row per (document, rule).

    ``axis_rows``: (document_id, axis_key, status, anchor_value, anchor_max);
    ``evidence``: (document_id, axis_key, position).
    """
    there = fragments.select("document_id", "position").distinct().withColumn("there", F.lit(True))
    cited = evidence.join(moved(there), ["document_id", "position"], "left").groupBy("document_id", "axis_key").agg(
        F.count("*").alias("cited"), F.count_if(F.col("there").isNull()).alias("dangling"))
    status, low, high = F.col("status"), F.col("anchor_value"), F.col("anchor_max")
    rows = axis_rows.join(moved(cited), ["document_id", "axis_key"], "left").groupBy("document_id").agg(
        F.count_distinct("axis_key").alias("axes"),
        F.bool_or(status.isin("known", "range") & (F.coalesce("cited", F.lit(0)) == 0)).alias("unsupported"),
        F.bool_or(F.coalesce("dangling", F.lit(0)) > 0).alias("dangling"),
        F.bool_or(((status == "known") & ~F.coalesce(low.isin(0, 50, 100), F.lit(False)))
                  | ((status == "range") & ~F.coalesce(high - low == 50, F.lit(False)))).alias("bad_anchor"))
    return _violations(rows, "document_id", {
        "axes_incomplete": F.col("axes") != 8, "evidence_missing": F.col("unsupported"),
        "evidence_dangling": F.col("dangling"), "anchor_illegal": F.col("bad_anchor")})
