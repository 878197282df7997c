"""Writing results once: natural keys, replays, conflicts, identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.operators.chains import reachable, split_next
from fitgrid.operators.keyed import newest, top_per_key
from fitgrid.session import checkpointed


def content_hash(*columns: str) -> Column:
    """Hash of the columns as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def new_rows(incoming: DataFrame, stored: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows whose natural key is not stored yet; the first of a key wins."""
    first = top_per_key(incoming, list(key), list(order))
    return first.join(stored.select(*key), list(key), "left_anti")


def append_report(incoming: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many keys an append inserts and how many were there already."""
    keys = incoming.select(*key).groupBy(*key).agg(F.count("*").alias("n"))
    marked = keys.join(stored.select(*key).distinct().withColumn("there", F.lit(True)), list(key), "left")
    return marked.groupBy(
        F.when(F.col("there"), "existing").otherwise("inserted").alias("outcome")
    ).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))


def latest_requests(requests: DataFrame) -> DataFrame:
    """Newest request per (user, url)."""
    return top_per_key(requests, ["user_id", "url_id"], newest("ts", "event_id"))


def resolve_requests(
    urls: DataFrame, jobs: DataFrame, sources: DataFrame, fresh_after: Column
) -> DataFrame:
    """fresh / stale / queued per url.

    A completed job counts when its evaluation rests on this url; its age is its
    oldest source. Without a fresh one the oldest active job is joined, else one
    new job is asked for.
    """
    done = jobs.where("status = 'completed' and evaluation_id is not null").select(
        "url_id", "job_id", "evaluation_id", F.col("created_at").alias("updated_at"))
    # Ages are formed per (job, url), so each source row meets only its own evaluation.
    aged = done.join(sources.withColumnRenamed("url_id", "source_url_id"), "evaluation_id").groupBy(
        "url_id", "job_id", "evaluation_id", "updated_at").agg(
        F.min("fetched_at").alias("oldest_fetched_at"),
        F.bool_or(F.col("source_url_id") == F.col("url_id")).alias("own"))
    best = top_per_key(
        aged.where("own").withColumn("is_fresh", F.col("oldest_fetched_at") >= fresh_after),
        ["url_id"], newest("is_fresh", "updated_at", "job_id")
    ).select("url_id", "evaluation_id", "oldest_fetched_at", "is_fresh")
    active = top_per_key(
        jobs.where("status in ('queued', 'running')"), ["url_id"],
        [F.col("created_at").asc(), F.col("job_id").asc()]
    ).select("url_id", F.col("job_id").alias("active_job_id"))
    fresh = F.coalesce("is_fresh", F.lit(False))
    return (
        urls.join(best, "url_id", "left").join(active, "url_id", "left")
        .select(
            "url_id",
            F.when(fresh, "fresh").when(F.col("evaluation_id").isNull(), "queued").otherwise("stale")
            .alias("request_status"),
            F.when(~fresh, F.col("active_job_id")).alias("job_id"),
            (~fresh & F.col("active_job_id").isNull()).alias("starts_job"),
            "evaluation_id", "oldest_fetched_at")
    )


def evaluation_outcomes(submitted: DataFrame, stored: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per natural key: insert, replay of equal content, or conflict of different content.

    ``submitted`` and ``stored`` carry ``content_hash``; the first submission counts.
    """
    key = list(key)
    groups = submitted.groupBy(*key).agg(
        F.count("*").alias("submissions"), F.min("content_hash").alias("low"),
        F.max("content_hash").alias("high"),
        F.min_by("content_hash", F.struct(*order)).alias("first_hash"))
    there = stored.select(*key, F.col("content_hash").alias("stored_hash"))
    effective = F.coalesce("stored_hash", "first_hash")
    differs = (F.col("low") != effective) | (F.col("high") != effective)
    return groups.join(there, key, "left").select(
        *key, "submissions", effective.alias("content_hash"),
        F.when(F.col("stored_hash").isNull(), F.when(differs, "inserted_with_conflict").otherwise("inserted"))
        .otherwise(F.when(differs, "conflict").otherwise("replayed")).alias("outcome"))


def _accepted_runs(submissions: DataFrame, latest: DataFrame, bucket_seconds: int) -> DataFrame:
    """``event_id`` of the submissions that accept one another in turn, without regard to their keys.

    From an accepted submission that expects version v, the next accepted one is
    the first later submission of its user that expects v + 1; the first of all
    is the earliest that expects the user's current version. So the links are
    known at once and the runs are followed by pointer doubling.
    """
    asked = submissions.select("user_id", F.col("expected_version").alias("level"), "ts", "event_id", F.lit(0).alias("probe"))
    timeline = asked.unionByName(asked.withColumn("level", F.col("level") + 1).withColumn("probe", F.lit(1))).withColumn(
        "bucket", F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(bucket_seconds * 1_000_000)))
    links = split_next(
        timeline, ["user_id", "level"], "bucket", ["ts", "event_id", "probe"], F.col("probe") == 0, "event_id", "next"
    ).where("probe = 1").select(F.col("event_id").alias("id"), "next")
    heads = submissions.join(latest, "user_id").where("expected_version = version").groupBy("user_id").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("id"))
    return reachable(links, heads).withColumnRenamed("id", "event_id")


def profile_submissions(submissions: DataFrame, latest: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Outcome of each profile submission, taken per user in (ts, event_id) order.

    A submission is accepted if it expects the user's current version, which
    then grows by one. An accepted key seen again is a replay, or a conflict if
    its content changed. ``event_id`` tells submissions apart; rows without user
    or of a user without a version are version conflicts.

    All users' runs of accepted submissions are found together, in as many
    rounds as the longest has binary digits. A run that accepts a key twice is
    right up to the second time: what repeats a key of that part can only be a
    replay, so it is taken out, and the users concerned are followed again.
    """
    waiting, accepted = submissions.where("user_id is not null and expected_version is not null"), None
    while True:
        run = checkpointed(waiting.join(_accepted_runs(waiting, latest, bucket_seconds), "event_id", "left_semi").select(
            "user_id", "event_id", "ts", "idempotency_key", "payload", F.col("expected_version").alias("current")))
        own_key = Window.partitionBy("user_id", "idempotency_key").orderBy("current")
        repeats = checkpointed(run.withColumn("n", F.row_number().over(own_key)).where(
            (F.col("n") > 1) & F.col("idempotency_key").isNotNull()).groupBy("user_id").agg(F.min("current").alias("wrong")))
        right = run.join(repeats, "user_id", "left_anti")
        accepted = right if accepted is None else accepted.unionByName(right)
        if repeats.isEmpty():
            break
        known = run.join(repeats, "user_id").where("current < wrong").select(
            "user_id", "idempotency_key", F.col("event_id").alias("first_id"))
        waiting = checkpointed(waiting.join(repeats, "user_id", "left_semi").join(
            known, ["user_id", "idempotency_key"], "left").where(
            F.col("first_id").isNull() | (F.col("first_id") == F.col("event_id"))).drop("first_id"))
    taken = accepted.select(
        "user_id", "idempotency_key", F.col("event_id").alias("taken_id"), F.col("ts").alias("taken_ts"),
        F.col("payload").alias("taken_payload"), (F.col("current") + 1).alias("new_version"))
    own = F.col("taken_id") == F.col("event_id")
    # A struct of nulls sorts first, so the absence of an accepted row is tested by itself.
    before = F.col("taken_id").isNotNull() & (F.struct("taken_ts", "taken_id") < F.struct("ts", "event_id"))
    outcome = (F.when(own, "accepted")
               .when(before & (F.col("taken_payload") == F.col("payload")), "replayed")
               .when(before, "idempotency_conflict").otherwise("version_conflict"))
    return submissions.join(taken, ["user_id", "idempotency_key"], "left").select(
        "user_id", "event_id", outcome.alias("outcome"), F.when(own, F.col("new_version")).alias("new_version"))


def posting_identities(seen: DataFrame, postings: DataFrame) -> DataFrame:
    """(url, title, employer) → the oldest existing posting, or a new id made from the three."""
    key = ["url_id", "title", "employer"]
    oldest = postings.groupBy(*key).agg(F.min("job_posting_id").alias("existing"))
    new_id = F.substring(F.sha2(F.concat_ws("|", F.col("url_id").cast("string"), "title", "employer"), 256), 1, 16)
    return seen.select(*key).distinct().join(oldest, key, "left").select(
        *key, F.coalesce(F.col("existing").cast("string"), new_id).alias("posting"),
        F.col("existing").isNull().alias("is_new"))


def discovery_results(results: DataFrame, postings: DataFrame) -> DataFrame:
    """Verified results → stored rows: known postings are reused, positions kept, first duplicate wins.

    ``results``: (request_id, position, url, title, company_name, source_kind).
    """
    clean = results.select(
        "request_id", "position", "url", F.trim("title").alias("title"),
        F.trim("company_name").alias("company_name"), "source_kind"
    ).where(
        F.length("title").between(1, 300) & F.length("company_name").between(1, 300)
        & F.col("url").startswith("https://") & (F.length("url") <= 2048)
        & F.col("source_kind").isin("official", "ats", "web"))
    key = ["url", "title", "company_name"]
    oldest = postings.groupBy(*key).agg(F.min("job_posting_id").alias("existing"))
    new_id = F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 16)
    rows = clean.join(oldest, key, "left").withColumn(
        "posting", F.coalesce(F.col("existing").cast("string"), new_id))
    return top_per_key(rows, ["request_id", "posting"], [F.col("position").asc()]).select(
        "request_id", "position", "posting", F.col("existing").isNull().alias("is_new"), "source_kind")
