"""Streams over several files: same decisions as the batch form, late rows, repeated batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fitgrid.operators import admission
from fitgrid.schemas import RAW_TABLES
from fitgrid.session import scratch_path
from fitgrid.sources.sinks import append_new, append_new_in_stream
from fitgrid.streaming import keyed, runs, windows

START = dt.datetime(2024, 1, 1)


def write(spark, path, rows):
    """One more events file; every file is a micro-batch of its own."""
    full = [(i, ts, user, kind, float(value), "{}") for i, ts, user, kind, value in rows]
    spark.createDataFrame(full, RAW_TABLES["events"]).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")


def stream(spark, path):
    rows = spark.readStream.schema(RAW_TABLES["events"]).option("maxFilesPerTrigger", 1).parquet(f"{path}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def batches(seed, n=3, size=60):
    rng = random.Random(seed)
    out, at = [], START
    for b in range(n):
        rows = []
        for i in range(size):
            at += dt.timedelta(minutes=rng.randrange(40))
            rows.append((b * size + i, at, rng.choice([1, 1, 2, 3]), rng.choice(["click", "view"]), rng.randrange(30)))
        out.append(rows)
    return out


def test_admissions_over_micro_batches_equal_the_batch_form(spark):
    path, parts = scratch_path(spark, "in"), batches(1)
    for rows in parts:
        write(spark, path, rows)
    asked = stream(spark, path).withColumn("item", F.col("value").cast("bigint") % 4)
    got = runs.run_to_table(keyed.admission_stream(asked, "user_id", 2, 7200, "item"), "t")
    stored = spark.read.schema(RAW_TABLES["events"]).parquet(f"{path}/events.parquet").withColumn("item", F.col("value").cast("bigint") % 4)
    want = admission.rolling_admissions(stored, "user_id", 2, 7200, item="item")
    assert {r.event_id: r.decision for r in got.collect()} == {r.event_id: r.decision for r in want.collect()}


def test_budget_over_micro_batches_equals_the_batch_form(spark):
    path = scratch_path(spark, "in")
    for rows in batches(2):
        write(spark, path, rows)
    units = (1 + F.col("event_id") % 5).alias("units")
    got = runs.run_to_table(keyed.budget_stream(stream(spark, path).select("*", units), 60), "t")
    stored = spark.read.schema(RAW_TABLES["events"]).parquet(f"{path}/events.parquet").select("*", units, F.to_date("ts").alias("usage_date"))
    want = admission.budget_reservations(stored, 60)
    assert {r.event_id: r.reserved for r in got.collect()} == {r.event_id: r.reserved for r in want.collect()}


def test_late_rows_are_dropped_and_counted(spark):
    path = scratch_path(spark, "in")
    at = lambda hours: START + dt.timedelta(hours=hours)
    write(spark, path, [(1, at(0.5), 1, "click", 1), (2, at(5), 1, "click", 1)])
    write(spark, path, [(3, at(6), 1, "click", 1)])
    write(spark, path, [(4, at(0.6), 1, "click", 1), (5, at(9), 1, "click", 1)])
    rows = stream(spark, path).select(
        "ts", F.col("event_type").alias("route"), F.lit(200).alias("status"), F.lit(5).cast("bigint").alias("duration_ms"))
    table, dropped = runs.run_and_count_dropped(windows.windowed_metrics(rows), "t")
    assert {r.window_start.hour: r.requests for r in table.collect()} == {0: 1, 5: 1, 6: 1}
    assert dropped == 1


def test_leases_expire_by_timer_and_attempts_are_bounded(spark):
    path = scratch_path(spark, "in")
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    write(spark, path, [(1, at(0), 7, "run", 60), (2, at(0), 8, "run", 60)])
    write(spark, path, [(3, at(0.5), 8, "run", 600), (4, at(30), 9, "run", 60)])
    write(spark, path, [(5, at(31), 7, "run", 60), (6, at(60), 9, "run", 0)])
    write(spark, path, [(7, at(90), 9, "run", 60)])
    changes = stream(spark, path).select(F.col("user_id").alias("job_id"), "event_id", "ts", F.col("value").cast("bigint").alias("lease_seconds"))
    table = runs.run_to_table(keyed.lease_stream(changes, max_attempts=2, late="1 minute"), "t")
    got = sorted((r.job_id, r.outcome, r.attempts) for r in table.collect())
    assert got == [(7, "failed", 2), (7, "requeued", 1), (8, "requeued", 1), (9, "requeued", 1)]


def test_consent_follows_the_latest_decision(spark):
    path = scratch_path(spark, "in")
    write(spark, path, [(1, START, 1, "granted", 1), (2, START, 2, "granted", 1)])
    write(spark, path, [(3, START + dt.timedelta(hours=1), 1, "withdrawn", 1), (4, START + dt.timedelta(hours=1), 3, "granted", 2)])
    rows = stream(spark, path).select(
        "ts", "event_id", "user_id", F.lit("p").alias("purpose"), F.col("value").cast("bigint").alias("policy_id"),
        F.col("event_type").alias("action"))
    updates = runs.run_to_table(windows.latest_decisions(rows), "t", mode="update")
    def current(n):
        return spark.createDataFrame([("p", n)], "purpose string, policy_id bigint")
    assert [r.user_id for r in windows.live_consent(updates, current(1)).collect()] == [2]
    assert [r.user_id for r in windows.live_consent(updates, current(2)).collect()] == [3]


def test_a_repeated_batch_changes_nothing(spark):
    path = scratch_path(spark, "sink")
    order = [F.col("v").asc()]
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    second = spark.createDataFrame([(2, "z"), (3, "d")], "k int, v string")
    for _ in range(2):
        append_new(first, path, ["k"], order, "1")
    for _ in range(2):
        append_new(second, path, ["k"], order, "2")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_streamed_rows_are_appended_once(spark):
    source, path = scratch_path(spark, "in"), scratch_path(spark, "sink")
    for rows in batches(3, n=2, size=10):
        write(spark, source, rows)
    query = stream(spark, source).select("event_id", "user_id").writeStream.trigger(availableNow=True).option(
        "checkpointLocation", scratch_path(spark, "state")).foreachBatch(
        append_new_in_stream(path, ["user_id"], [F.col("event_id").asc()])).start()
    query.awaitTermination()
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("user_id").distinct().count() == 3


def state_rows(query):
    return sum(operator["numRowsTotal"] for operator in query.lastProgress["stateOperators"])


def test_leases_leave_no_state(spark):
    path = scratch_path(spark, "in")
    at = lambda hours: START + dt.timedelta(hours=hours)
    write(spark, path, [(1, at(0), 1, "click", 1), (2, at(0.1), 2, "click", 1), (3, at(0.5), 1, "purchase", 0)])
    write(spark, path, [(4, at(8), 3, "purchase", 0)])  # the lease of job 2 has run out
    write(spark, path, [(5, at(9), 3, "purchase", 0)])
    changes = stream(spark, path).select(
        F.col("user_id").alias("job_id"), "event_id", "ts", (F.col("value") * 3600).cast("bigint").alias("lease_seconds"))
    query, table = runs._run(keyed.lease_stream(changes, max_attempts=1), "leases", "append")
    assert sorted((r.job_id, r.outcome) for r in table.collect()) == [(1, "completed"), (2, "failed")]
    assert state_rows(query) == 0


def test_budget_state_goes_with_the_day(spark):
    path = scratch_path(spark, "in")
    for day in range(4):
        write(spark, path, [(10 * day + i, START + dt.timedelta(days=day, hours=i), 1, "click", 1) for i in range(5)])
    units = F.lit(3).alias("units")
    query, table = runs._run(keyed.budget_stream(stream(spark, path).select("*", units), 7), "budget", "append")
    assert {r.event_id for r in table.where("reserved").collect()} == {10 * d + i for d in range(4) for i in (0, 1)}
    assert state_rows(query) <= 2  # the last day, and the one that the watermark has not passed yet; with its timer


def test_rolling_abuse_counts_over_micro_batches(spark):
    rng, path, rows, n = random.Random(3), scratch_path(spark, "in"), [], 0
    for b in range(3):
        part = []
        for _ in range(80):  # each batch reaches back into the days of the one before
            at = START + dt.timedelta(days=3 * b + rng.randrange(6), minutes=rng.randrange(1440))
            part.append((n, at, rng.randrange(6), rng.choice(["click", "view"]), rng.randrange(4)))
            n += 1
        write(spark, path, part)
        rows += part
    events = stream(spark, path).select(
        "ts", "event_type", F.when(F.col("value") > 0, F.col("value").cast("string")).alias("ip_key"), "user_id")
    got = windows.abuse_days(runs.run_to_table(windows.abuse_pairs(events), "abuse", mode="update")).collect()
    last = max(r[1] for r in rows).date()
    want = set()
    for offset in range((last - START.date()).days + 1):
        day = START.date() + dt.timedelta(days=offset)
        for kind in ("click", "view"):
            own = [r for r in rows if r[3] == kind and 0 <= (day - r[1].date()).days < 7]
            widths = [len({r[2] for r in own if r[4] == k}) for k in range(1, 4)]
            if own:
                want.add((day, kind, len(own), len({r[2] for r in own}), max(widths)))
    assert {(r.day, r.event_type, r.events, r.users, r.max_users_per_ip_key) for r in got} == want
    assert max(r.day for r in got) == last


def test_a_batch_reads_its_own_buckets_only(spark):
    from fitgrid.sources.sinks import read_appended, stored_keys
    path = scratch_path(spark, "sink")
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    append_new(rows, path, ["k"], [F.col("v")], "1")
    placed = spark.read.parquet(path)
    own = placed.where("k = 77").first().key_bucket
    read = stored_keys(placed, ["k"], [own])
    files = {r.f for r in read.select(F.input_file_name().alias("f")).collect()}
    assert len(files) == 1 < len(placed.inputFiles())
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan and "v" not in plan.split("ReadSchema: ")[1].split(">")[0]
    append_new(spark.createDataFrame([(77, "b"), (900, "c")], rows.schema), path, ["k"], [F.col("v")], "2")
    append_new(spark.createDataFrame([(77, "b"), (900, "c")], rows.schema), path, ["k"], [F.col("v")], "2")
    stored = read_appended(spark, rows.schema, path)
    assert stored.columns == ["k", "v"] and stored.count() == 501
    assert [r.v for r in stored.where("k in (77, 900)").orderBy("k").collect()] == ["a", "c"]
