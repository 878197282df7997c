"""Chains of rows that decide one another: the next row of a kind, and all rows that a first one leads to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.operators.keyed import split_lag, split_running_sum
from fitgrid.session import scratch_path


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_next(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], wanted: Column, carried: str, name: str,
) -> DataFrame:
    """``carried`` of the next later row that is ``wanted``, over ``keys`` in ``order``; null without one.

    ``bucket`` must be a non-decreasing function of the order. A row looks ahead
    inside its bucket; beyond it, one row per bucket says what the first wanted
    row behind it is. Keys must not be null.
    """
    keys, order = list(keys), list(order)
    ahead = (1, Window.unboundedFollowing)
    value = F.when(wanted, F.struct(F.col(carried).alias("v")))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(*ahead)
    over_buckets = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(*ahead)
    firsts = df.groupBy(*keys, bucket).agg(
        F.min_by(value, F.when(wanted, F.struct(*order))).alias("__first"))
    behind = firsts.select(*keys, bucket, F.first("__first", ignorenulls=True).over(over_buckets).alias("__behind"))
    return df.withColumn("__inside", F.first(value, ignorenulls=True).over(inside)).join(
        behind, [*keys, bucket]).select(*df.columns, F.coalesce("__inside", "__behind")["v"].alias(name))


def sessions(df: DataFrame, keys: Sequence[str], time: str, tie: str, gap: int, name: str) -> DataFrame:
    """Numbers the runs of each key whose rows follow each other within ``gap`` (units of the whole-number ``time``).

    Keys must not be null. Only one row per key and sixteenth of a gap is ever
    looked at across a whole key.
    """
    keys = list(keys)
    dealt = df.withColumn("__bucket", F.call_function("div", F.col(time), F.lit(max(1, gap // 16))))
    lagged = split_lag(dealt, keys, "__bucket", [time, tie], [time], "__last_")
    before = F.col(f"__last_{time}")
    starts = lagged.withColumn("__start", (before.isNull() | (F.col(time) - before > gap)).cast("int"))
    return split_running_sum(starts, keys, "__bucket", [time, tie], F.col("__start"), name).select(
        *df.columns, F.col("__start").cast("boolean").alias("__first"), name)


def reachable(links: DataFrame, heads: DataFrame) -> DataFrame:
    """``id`` of all rows that ``links`` (``id, next``; one per id at most) lead to from ``heads`` (``id``), heads included.

    Pointer doubling: links double their reach every round, so the longest chain
    takes as many rounds as its length has binary digits. Each round joins whole
    tables by id and is written to the shared folder.
    """
    jump = _written(links.where("next is not null"), "links")
    found = _written(heads.select("id").distinct(), "reached")
    n = found.count()
    while True:
        step = found.join(jump, "id").select(F.col("next").alias("id"))
        found = _written(found.unionByName(step).distinct(), "reached")
        more = found.count()
        if more == n:
            return found
        n = more
        onward = jump.select(F.col("id").alias("next"), F.col("next").alias("after"))
        jump = _written(jump.join(onward, "next").select("id", F.col("after").alias("next")), "links")
