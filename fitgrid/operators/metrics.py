"""Windowed service metrics and alert rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrid.operators.chains import split_next
from fitgrid.operators.keyed import split_lag, split_running_sum


def hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def request_rate(requests: DataFrame) -> DataFrame:
    return requests.groupBy(hour(F.col("ts")).alias("window_start"), "route").agg(
        F.count("*").alias("requests")
    ).withColumn("per_second", F.col("requests") / F.lit(3600.0))


def latency_quantiles(
    requests: DataFrame, window: Column, quantiles: Sequence[float] = (0.5, 0.9, 0.95)
) -> DataFrame:
    """Exact quantiles per (window, route) over value frequencies.

    Equal durations are counted before the shuffle, so a busy route sends its
    distinct values and not its requests to the final aggregate.
    """
    counted = requests.groupBy(window.alias("window_start"), "route", "duration_ms").agg(
        F.count("*").alias("n"))
    return counted.groupBy("window_start", "route").agg(
        F.sum("n").alias("requests"),
        *[F.round(F.percentile("duration_ms", F.lit(q), F.col("n")), 3).alias(f"p{round(q * 100)}")
          for q in quantiles])


def histogram_quantile(requests: DataFrame, bounds: Sequence[int], q: float) -> DataFrame:
    """Quantile by linear interpolation inside cumulative buckets, per (hour, route).

    The last bucket has no upper bound; a quantile falling there is the highest finite bound.
    """
    value = F.col("duration_ms")
    counts = requests.groupBy(hour(F.col("ts")).alias("window_start"), "route").agg(
        F.count("*").alias("n"), *[F.count_if(value <= b).alias(f"le_{b}") for b in bounds])
    return counts.select("window_start", "route", "n", F.round(bucket_quantile(bounds, q), 6).alias("estimate"))


def bucket_quantile(bounds: Sequence[int], q: float) -> Column:
    """Quantile from the cumulative counts ``le_<bound>`` of ``n`` values."""
    target = F.col("n") * F.lit(q)
    estimate = None
    low, before = 0, F.lit(0)
    for b in bounds:
        upto = F.col(f"le_{b}")
        inside = low + (b - low) * (target - before) / (upto - before)
        estimate = F.when(upto >= target, inside) if estimate is None else estimate.when(upto >= target, inside)
        low, before = b, upto
    return estimate.otherwise(F.lit(float(bounds[-1])))


def error_ratio(requests: DataFrame) -> DataFrame:
    return requests.groupBy(hour(F.col("ts")).alias("window_start")).agg(
        F.count_if(F.col("status") >= 500).alias("errors"), F.count("*").alias("requests")
    ).withColumn("error_share", F.try_divide("errors", "requests"))


def outcome_counts(events: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """One column per known outcome and hour; naming the outcomes avoids a scan for them."""
    return events.groupBy(hour(F.col("ts")).alias("window_start")).agg(*[
        F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])


def tokens_per_call(messages: DataFrame) -> DataFrame:
    """Tokens per direction over the number of answered calls."""
    calls = messages.agg(F.count_if(F.col("direction") == "output")).scalar()
    return messages.groupBy("direction").agg(F.sum("tokens").alias("tokens")).select(
        "direction", "tokens", calls.alias("calls")
    ).withColumn("per_call", F.round(F.try_divide("tokens", "calls"), 6))


# Alerts -----------------------------------------------------------------------------------------

def sliding(requests: DataFrame, window_seconds: int, step_seconds: int) -> DataFrame:
    """Each row once per evaluation step ``instant`` (whole steps, in seconds) whose last ``window_seconds`` hold it."""
    first = F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(step_seconds * 1_000_000)) * step_seconds
    return requests.withColumn("instant", F.explode(F.sequence(first, first + window_seconds - step_seconds, F.lit(step_seconds))))


def error_share_samples(requests: DataFrame, window_seconds: int, step_seconds: int, above: float) -> DataFrame:
    """``series, instant`` of every evaluation at which the share of failed requests was above the limit."""
    shares = sliding(requests.select("ts", "status"), window_seconds, step_seconds).groupBy("instant").agg(
        F.count_if(F.col("status") >= 500).alias("errors"), F.count("*").alias("n"))
    return shares.where(F.col("errors") / F.col("n") > above).select(F.lit("all").alias("series"), "instant")


def slow_route_samples(
    requests: DataFrame, window_seconds: int, step_seconds: int, above_ms: float, bounds: Sequence[int], q: float = 0.95,
) -> DataFrame:
    """``series, instant`` of every evaluation at which a route's quantile, from cumulative buckets, was above the limit."""
    value = F.col("duration_ms")
    counts = sliding(requests.select("ts", "route", "duration_ms"), window_seconds, step_seconds).groupBy("route", "instant").agg(
        F.count("*").alias("n"), *[F.count_if(value <= b).alias(f"le_{b}") for b in bounds])
    return counts.where(bucket_quantile(bounds, q) > above_ms).select(F.col("route").alias("series"), "instant")


def failure_samples(calls: DataFrame, window_seconds: int, step_seconds: int, above: int) -> DataFrame:
    """``series, instant`` of every evaluation at which an operation (``operation``, ``outcome``) failed more often than the limit."""
    failed = calls.where("outcome <> 'ok'").select("ts", "operation")
    return sliding(failed, window_seconds, step_seconds).groupBy("operation", "instant").agg(F.count("*").alias("n")).where(
        F.col("n") > above).select(F.col("operation").alias("series"), "instant")


def sampled_holds(breaches: DataFrame, step_seconds: int, hold_seconds: int) -> DataFrame:
    """``series, started_at, until`` of stretches of breached evaluations that lasted the hold time at least.

    ``breaches`` has one row per breached (series, instant), ``instant`` in whole steps. A
    stretch ends where the next step is missing. Distances and stretch numbers
    are found day by day, and one row per day is carried over a series.
    """
    daily = breaches.withColumn("day", F.call_function("div", F.col("instant"), F.lit(86_400)))
    lagged = split_lag(daily, ["series"], "day", ["instant"], ["instant"])
    starts = lagged.withColumn("start", F.when(F.col("previous_instant") == F.col("instant") - step_seconds, 0).otherwise(1))
    stretches = split_running_sum(starts, ["series"], "day", ["instant"], F.col("start"), "stretch").groupBy("series", "stretch").agg(
        F.min("instant").alias("started_at"), F.max("instant").alias("until"))
    return stretches.where(F.col("until") - F.col("started_at") >= hold_seconds).select(
        "series", F.timestamp_seconds("started_at").cast("timestamp_ntz").alias("started_at"),
        F.timestamp_seconds("until").cast("timestamp_ntz").alias("until"))


def gauge_holds(changes: DataFrame, above: int, hold_seconds: int) -> DataFrame:
    """``series, started_at, until`` of the times a gauge stood above the limit for the hold time at least.

    ``changes`` gives the value from each instant on (``series, instant, value``). Only
    crossings of the limit are paired: each rise with the next fall, looked up
    inside its month or in one row per later month. A stretch that has not ended
    has no ``until`` and counts as held.
    """
    marked = changes.select("series", "instant", (F.col("value") > above).alias("over"), F.trunc(F.col("instant").cast("date"), "month").alias("month"))
    lagged = split_lag(marked, ["series"], "month", ["instant"], ["over"])
    crossings = lagged.where(F.col("over") != F.coalesce("previous_over", F.lit(False))).drop("previous_over")
    paired = split_next(crossings, ["series"], "month", ["instant"], ~F.col("over"), "instant", "until").where("over")
    held = F.col("until").isNull() | (F.col("until") >= F.col("instant") + F.make_dt_interval(secs=F.lit(hold_seconds)))
    return paired.where(held).select("series", F.col("instant").alias("started_at"), "until")


def alerts(holds: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """``rule, series, started_at, fired_at, until`` of all rules; ``holds`` gives each rule's stretches and hold seconds."""
    rows = [found.select(
        F.lit(rule).alias("rule"), "series", "started_at",
        (F.col("started_at") + F.make_dt_interval(secs=F.lit(seconds))).alias("fired_at"), "until")
        for rule, (found, seconds) in holds.items()]
    return reduce(DataFrame.unionByName, rows)
