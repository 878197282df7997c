"""Windowed metrics and latest-state streams, all built in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def windowed_metrics(requests: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Requests, errors and duration sums per window and route; a window closes when the watermark passes."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return requests.withWatermark("ts", LATE).groupBy(window.alias("w"), "route").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"),
        F.sum("duration_ms").alias("duration_ms")
    ).select(F.col("w.start").alias("window_start"), "route", "requests", "errors", "duration_ms")


def abuse_pairs(events: DataFrame, days: int = 7) -> DataFrame:
    """Events per day, type, shared key and user, as an update log; a day's state goes once it is ``days`` old.

    Updates name the whole new count, so the last one of a key replaces the others.
    """
    return events.withWatermark("ts", f"{days} days").groupBy(
        F.window("ts", "1 day").alias("w"), "event_type", "ip_key", "user_id").agg(F.count("*").alias("events")
    ).select(F.col("w.start").cast("date").alias("day"), "event_type", "ip_key", "user_id", "events")


def abuse_days(updates: DataFrame, days: int = 7) -> DataFrame:
    """``day, event_type, events, users, max_users_per_ip_key`` over the ``days`` days that end with each day.

    ``updates`` is the log of ``abuse_pairs``. Days up to the last one seen are
    there, the current one included. Pairs of user and key are counted, not
    events, so a key that very many events share moves one row per user and day.
    """
    newest = updates.groupBy("day", "event_type", "ip_key", "user_id").agg(F.max_by("events", "batch_id").alias("events"))
    last = newest.agg(F.max("day")).scalar()
    rolling = newest.withColumn(
        "day", F.explode(F.sequence(F.col("day"), F.least(F.date_add("day", days - 1), last))))
    per_user = rolling.groupBy("day", "event_type", "ip_key", "user_id").agg(F.sum("events").alias("events"))
    widths = per_user.where("ip_key is not null").groupBy("day", "event_type", "ip_key").agg(F.count("*").alias("n")).groupBy(
        "day", "event_type").agg(F.max("n").alias("max_users_per_ip_key"))
    users = per_user.groupBy("day", "event_type", "user_id").agg(F.sum("events").alias("events")).groupBy(
        "day", "event_type").agg(F.sum("events").alias("events"), F.count("*").alias("users"))
    return users.join(widths, ["day", "event_type"], "left").fillna(0, ["max_users_per_ip_key"])


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Running latest decision per (purpose, user)."""
    return decisions.groupBy("purpose", "user_id").agg(
        F.max(F.struct("ts", "event_id", "policy_id", "action")).alias("latest")
    ).select("purpose", "user_id", "latest.*")


def live_consent(updates: DataFrame, current_policies: DataFrame) -> DataFrame:
    """Consented users from the update log of ``latest_decisions``; a newer policy empties the set."""
    newest = updates.groupBy("purpose", "user_id").agg(
        F.max(F.struct("ts", "event_id", "policy_id", "action")).alias("latest"))
    granted = newest.where("latest.action = 'granted'").select(
        "purpose", "user_id", F.col("latest.policy_id").alias("policy_id"))
    return granted.join(current_policies.select("purpose", "policy_id"), ["purpose", "policy_id"]) \
        .select("purpose", "user_id")
