"""Axis comparison as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitgrid.schemas import CLOSE_DIFFERENCE


def axis_differences(preference: Column, anchor: Column, anchor_max: Column) -> tuple[Column, Column]:
    """Smallest and largest distance of an answer to the one or two observed anchors."""
    low = F.abs(preference - anchor)
    high = F.abs(preference - anchor_max)
    return F.least(low, high), F.greatest(low, high)


def axis_comparison(
    preference: Column, importance: Column, status: Column, anchor: Column, anchor_max: Column
) -> Column:
    """``struct<comparison_status, difference, difference_max>`` for one answer and one observation.

    Importance 0 takes the axis out. Missing information keeps its own status
    and never turns into a number; a range may be close, different or partial.
    """
    nearest, farthest = axis_differences(preference, anchor, anchor_max)
    observed = F.coalesce(status, F.lit("unknown"))
    used = importance != 0
    single = used & (observed == "known")
    ranged = used & (observed == "range")
    verdict = (
        F.when(~used, "excluded")
        .when(single, F.when(nearest <= CLOSE_DIFFERENCE, "close").otherwise("different"))
        .when(
            ranged,
            F.when(farthest <= CLOSE_DIFFERENCE, "close")
            .when(nearest > CLOSE_DIFFERENCE, "different")
            .otherwise("partial"),
        )
        .otherwise(observed)
    )
    return F.struct(
        verdict.alias("comparison_status"),
        F.when(single | ranged, nearest).alias("difference"),
        F.when(ranged, farthest).alias("difference_max"),
    )


def status_counts(status: Column) -> list[Column]:
    """Close / different / partial / not-yet-known counts over comparison rows."""
    return [
        F.count_if(status == "close").alias("close_count"),
        F.count_if(status == "different").alias("different_count"),
        F.count_if(status == "partial").alias("partial_count"),
        F.count_if(status.isin("unknown", "conflicting", "stale")).alias("unknown_count"),
    ]


def int_div(a: Column, b: Column) -> Column:
    """Whole-number quotient of non-negative integers, without a detour over doubles."""
    return ((a - a % b) / b).cast("bigint")


def tenths(total: Column, n: Column) -> Column:
    """``total / n`` rounded half up to one place, from non-negative integers only."""
    return F.when(n > 0, int_div(total * 20 + n, n * 2) / F.lit(10.0))
