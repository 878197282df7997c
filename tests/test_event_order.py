"""Sequential rules against a plain loop, with one key holding most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fitgrid.operators import admission, consent, ingest
from fitgrid.operators.keyed import split_lag, split_row_number, split_running_sum, top_per_key

START = dt.datetime(2024, 1, 1)


def events(seed, n=400, users=3, items=5, span_hours=200):
    """(event_id, user_id, ts, item); half of the rows belong to user 0, some at equal times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < 0.5 else rng.randrange(users)
        rows.append((i, user, START + dt.timedelta(minutes=15 * rng.randrange(span_hours * 4)), rng.randrange(items)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, item bigint").repartition(5)


def loop(rows, limit, hours, use_item):
    window, taken, out = dt.timedelta(hours=hours), {}, {}
    for event_id, user, ts, item in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [(t, i) for t, i in taken.get(user, []) if t >= ts - window]
        if use_item and any(i == item for _, i in live):
            out[event_id] = "repeat"
        elif len(live) < limit:
            out[event_id] = "admitted"
            live.append((ts, item))
        else:
            out[event_id] = "rejected"
        taken[user] = live
    return out


@pytest.mark.parametrize("limit, hours, use_item", [
    (1, 6, False), (3, 24, False), (3, 12, True), (3, 1, False), (2, 30, True), (2, 40, True)])
def test_rolling_admissions_equal_a_loop(spark, limit, hours, use_item):
    rows = events(limit * 31 + hours)
    got = admission.rolling_admissions(
        frame(spark, rows), "user_id", limit, hours * 3600, item="item" if use_item else None)
    assert {r.event_id: r.decision for r in got.collect()} == loop(rows, limit, hours, use_item)


def test_rejected_requests_leave_no_trace(spark):
    rows = [(i, 1, START + dt.timedelta(hours=h), 0) for i, h in enumerate((0, 1, 2, 3, 25))]
    got = admission.rolling_admissions(frame(spark, rows), "user_id", 3, 86_400)
    assert [r.decision for r in got.orderBy("event_id").collect()] == ["admitted"] * 3 + ["rejected", "admitted"]


def test_ids_may_be_texts(spark):
    rows = [(str(i), "u", START + dt.timedelta(hours=i), "x" if i % 2 else "y") for i in range(6)]
    df = spark.createDataFrame(rows, "event_id string, user_id string, ts timestamp_ntz, item string")
    got = admission.rolling_admissions(df, "user_id", 1, 7200, item="item")
    assert [r.decision for r in got.orderBy("event_id").collect()] == [
        "admitted", "rejected", "repeat", "admitted", "rejected", "repeat"]


@pytest.mark.parametrize("hours", [1, 6, 50])
def test_single_flight_equals_a_loop(spark, hours):
    rows = events(70 + hours) + [(1000 + i, None, START + dt.timedelta(hours=i), 0) for i in range(9)]
    want = {k: "started" if v == "admitted" else "joined" for k, v in loop(rows, 1, hours, False).items()}
    got = admission.single_flight(frame(spark, rows), "user_id", hours * 3600).collect()
    assert {r.event_id: r.outcome for r in got} == want
    assert {r.event_id for r in got if r.user_id is None} == set(range(1000, 1009))


def jobs_of(spark, label, work):
    spark.sparkContext.setJobGroup(label, label)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(label))


def test_jobs_do_not_grow_with_the_span_of_time(spark):
    def spread(slices):
        rows = [(i, i % 3, START + dt.timedelta(minutes=i), i % 5) for i in range(slices)]
        return frame(spark, rows)
    counts = []
    for slices in (10, 10_000):
        table = spread(slices)
        for item in (None, "item"):
            counts.append(jobs_of(spark, f"admissions-{slices}-{item}", lambda t=table, i=item: admission.rolling_admissions(
                t, "user_id", 2, 60, item=i).collect()))
    assert max(counts) < 20
    rows = [(i, 0, START + dt.timedelta(seconds=40 * i), 0) for i in range(10_000)]  # one session of 5,000 starts
    found = admission.single_flight(frame(spark, rows), "user_id", 60).where("outcome = 'started'").collect()
    assert sorted(r.event_id for r in found) == list(range(0, 10_000, 2))


def test_next_of_a_kind(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), rng.randrange(60), rng.random() < 0.2) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, at bigint, wanted boolean").withColumn("b", F.floor(F.col("at") / 4))
    from fitgrid.operators.chains import split_next
    got = {r.id: r.n for r in split_next(df, ["k"], "b", ["at", "id"], F.col("wanted"), "id", "n").collect()}
    for i, k, at, _ in rows:
        later = sorted((a, j) for j, x, a, w in rows if x == k and w and (a, j) > (at, i))
        assert got[i] == (later[0][1] if later else None)


def test_budget_skips_and_goes_on(spark):
    rng = random.Random(5)
    rows = [(i, START + dt.timedelta(minutes=rng.randrange(4000)), rng.choice([1, 2, 3, 7, 40])) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, units bigint").withColumn(
        "usage_date", F.to_date("ts"))
    want, totals = {}, {}
    for event_id, ts, units in sorted(rows, key=lambda r: (r[1], r[0])):
        fits = totals.get(ts.date(), 0) + units <= 150
        want[event_id] = fits
        totals[ts.date()] = totals.get(ts.date(), 0) + (units if fits else 0)
    got = admission.budget_reservations(df, 150)
    assert {r.event_id: r.reserved for r in got.collect()} == want


@pytest.mark.parametrize("seed, user_limit, cap", [(1, 1, 2), (2, 2, 3), (3, 3, 1)])
def test_discoveries_equal_a_loop(spark, seed, user_limit, cap):
    rows = events(seed, n=250, users=8, items=9)
    active, fresh, own = (dt.timedelta(hours=h) for h in (20, 10, 50))
    starts, want = [], {}
    for event_id, user, ts, item in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = [s for s in starts if s[1] == user and s[0] >= ts - own]
        if any(s[2] == item and s[0] > ts - active for s in starts):
            want[event_id] = "joined"
        elif any(s[2] == item and s[0] >= ts - active - fresh for s in starts):
            want[event_id] = "reused"
        elif len(mine) >= user_limit:
            want[event_id] = "rate_limited"
        elif len([s for s in starts if s[0] > ts - active]) >= cap:
            want[event_id] = "busy"
        else:
            want[event_id] = "started"
            starts.append((ts, user, item))
    got = admission.discovery_decisions(
        frame(spark, rows).withColumnRenamed("item", "query_key"), 20 * 3600, 10 * 3600, user_limit, 50 * 3600, cap)
    assert {r.event_id: r.decision for r in got.collect()} == want


def test_split_windows_equal_plain_windows(spark):
    from pyspark.sql import Window
    df = frame(spark, events(9, n=300)).withColumn("day", F.to_date("ts"))
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    plain = df.select("event_id", F.lag("item").over(over).alias("p"), F.row_number().over(over).cast("bigint").alias("n"),
                      F.sum("item").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    lagged = split_lag(df, ["user_id"], "day", ["ts", "event_id"], ["item"]).select("event_id", F.col("previous_item").alias("p"))
    numbered = split_row_number(df, ["user_id"], "day", ["ts", "event_id"], "n").select("event_id", "n")
    summed = split_running_sum(df, ["user_id"], "day", ["ts", "event_id"], F.col("item"), "s").select("event_id", "s")
    got = lagged.join(numbered, "event_id").join(summed, "event_id").select("event_id", "p", "n", "s")
    assert {r.event_id: tuple(r) for r in got.collect()} == {r.event_id: tuple(r) for r in plain.collect()}


def test_salted_top_rows_equal_plain_ones(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(700)).alias("v"), "id")
    got = top_per_key(df, ["k"], [F.col("v").asc(), F.col("id").asc()], 150)
    want = df.orderBy("v", "id").limit(150)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_consent_history_keeps_changes_only(spark):
    rng = random.Random(3)
    rows, want, last = [], [], {}
    for i in range(200):
        user, ts = rng.randrange(3), START + dt.timedelta(hours=i)
        action, policy = rng.choice(["granted", "withdrawn"]), 1 + i // 100
        rows.append((i, user, "p", policy, action, ts))
        before = last.get(user)
        if (action, policy) == before or (action == "withdrawn" and (before is None or before[0] == "withdrawn")):
            continue
        want.append(i)
        last[user] = (action, policy)
    df = spark.createDataFrame(
        rows, "event_id bigint, user_id bigint, purpose string, policy_id bigint, action string, recorded_at timestamp_ntz")
    assert sorted(r.event_id for r in consent.consent_changes(df).collect()) == want


def test_profile_submissions_equal_a_loop(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(4), START + dt.timedelta(minutes=i), rng.randrange(12), rng.choice("ab"), rng.randrange(1, 5))
            for i in range(160)]
    version, taken, want = {u: 1 for u in range(4)}, {}, {}
    for event_id, user, ts, key, payload, expected in rows:
        if (user, key) in taken:
            want[event_id] = "replayed" if taken[user, key] == payload else "idempotency_conflict"
        elif expected == version[user]:
            want[event_id] = "accepted"
            taken[user, key] = payload
            version[user] += 1
        else:
            want[event_id] = "version_conflict"
    df = spark.createDataFrame(
        rows, "event_id bigint, user_id bigint, ts timestamp_ntz, idempotency_key bigint, payload string, expected_version bigint")
    latest = spark.createDataFrame([(u, 1) for u in range(4)], "user_id bigint, version bigint")
    got = ingest.profile_submissions(df, latest)
    assert {r.event_id: r.outcome for r in got.collect()} == want


SUBMISSIONS = "event_id bigint, user_id bigint, ts timestamp_ntz, idempotency_key bigint, payload string, expected_version bigint"


def submissions_by_loop(rows, versions):
    version, taken, want = dict(versions), {}, {}
    for event_id, user, ts, key, payload, expected in sorted(rows, key=lambda r: (r[2], r[0])):
        if (user, key) in taken:
            want[event_id] = "replayed" if taken[user, key] == payload else "idempotency_conflict", None
        elif user in version and expected == version[user]:
            taken[user, key] = payload
            version[user] += 1
            want[event_id] = "accepted", version[user]
        else:
            want[event_id] = "version_conflict", None
    return want


@pytest.mark.parametrize("keys, levels", [(3, 5), (40, 3), (12, 9)])
def test_submissions_with_many_repeated_keys(spark, keys, levels):
    rng = random.Random(keys)
    rows = [(i, rng.randrange(5), START + dt.timedelta(minutes=5 * rng.randrange(200)), rng.randrange(keys), rng.choice("ab"),
             rng.randrange(1, levels)) for i in range(400)]
    versions = {u: 1 + u % 2 for u in range(4)}  # user 4 has no version
    latest = spark.createDataFrame(list(versions.items()), "user_id bigint, version bigint")
    got = ingest.profile_submissions(spark.createDataFrame(rows, SUBMISSIONS), latest).collect()
    assert {r.event_id: (r.outcome, r.new_version) for r in got} == submissions_by_loop(rows, versions)


def test_one_user_with_thousands_of_versions(spark):
    rows = [(i, 0, START + dt.timedelta(minutes=i), i, "a", 1 + i // 2) for i in range(6000)]
    latest = spark.createDataFrame([(0, 1)], "user_id bigint, version bigint")
    found = []
    jobs = jobs_of(spark, "versions", lambda: found.extend(
        ingest.profile_submissions(spark.createDataFrame(rows, SUBMISSIONS), latest).collect()))
    assert {r.event_id: (r.outcome, r.new_version) for r in found} == submissions_by_loop(rows, {0: 1})
    assert sum(r.outcome == "accepted" for r in found) == 3000
    assert jobs < 200  # 13 rounds; one round a version would be 3,000
