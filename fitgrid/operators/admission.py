"""Admissions that depend on earlier admissions: allowances, quotas, budgets.

A refused request leaves no trace, so running sums over all requests are wrong
and the decisions of one key form a chain. It breaks wherever a key is idle for
a window: what was admitted before has expired. These sessions are found first,
and each is one sorted stream that carries the last few admissions. With a limit
of one, the request that follows an admission is known without any history, so
the chains themselves are followed by pointer doubling, a busy key in as many
tasks as its rows fill. Neither way depends on the span of time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrid.operators.chains import reachable, sessions, split_next
from fitgrid.operators.keyed import top_per_key
from fitgrid.session import scratch_path


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _types(df: DataFrame, *columns: str) -> dict[str, str]:
    """Column types by name; ids may be numbers or texts."""
    return {c: df.schema[c].dataType.simpleString() for c in columns}


def _ddl(types: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in types.items())


def _no_entries(types: dict[str, str]) -> Column:
    """An empty array of structs with these fields."""
    return F.array().cast(f"array<struct<{','.join(f'{name}:{kind}' for name, kind in types.items())}>>")


def _events(requests: DataFrame, key: str, item: str | None) -> DataFrame:
    """``key, us, event_id, item``, and the key as never null columns; a null key is a key of its own."""
    return requests.select(
        F.col(key).alias("key"), F.xxhash64(F.col(key).isNull(), F.col(key).cast("string")).alias("key_hash"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key_text"),
        _micros(F.col("ts")).alias("us"), "event_id", F.col(item or "event_id").alias("item"))


def _decide(batches: Iterator[pa.RecordBatch], limit: int, window_us: int) -> Iterator[pa.RecordBatch]:
    """Decisions of sessions that come one after another, each in order; at most ``limit`` admissions are remembered."""
    session, live = None, deque()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key_hash", "key_text", "session", "us", "item")]
        decided = []
        for *own, us, item in zip(*columns, strict=True):
            if own != session:
                session, live = own, deque()
            while live and live[0][0] < us - window_us:
                live.popleft()
            if any(x == item for _, x in live):
                decided.append("repeat")
            elif len(live) < limit:
                live.append((us, item))
                decided.append("admitted")
            else:
                decided.append("rejected")
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("event_id"), pa.array(decided, pa.string())], ["key", "event_id", "decision"])


def rolling_admissions(
    requests: DataFrame, key: str, limit: int, window_seconds: int, item: str | None = None,
) -> DataFrame:
    """Decision per request in (ts, event_id) order per key.

    admitted: fewer than ``limit`` admissions in the last ``window_seconds``;
    repeat: the same ``item`` was admitted in that time, which costs nothing;
    rejected: everything else.

    Requests of a key that was idle for longer than the window start afresh, so
    every such session is decided by itself, in one pass over its sorted rows
    with at most ``limit`` admissions in hand. A session is never gathered; a key
    that is never idle is one sorted stream. A null key is a key of its own.
    """
    window_us = window_seconds * 1_000_000
    events = _events(requests, key, item)
    own = ["key_hash", "key_text"]
    cut = sessions(events, own, "us", "event_id", window_us, "session")
    sorted_ = cut.select("key", *own, "session", "us", "event_id", "item").repartition(
        *own, "session").sortWithinPartitions(*own, "session", "us", "event_id")
    schema = _ddl(_types(events, "key", "event_id")) + ", decision string"
    return sorted_.mapInArrow(lambda batches: _decide(batches, limit, window_us), schema).withColumnRenamed("key", key)


def single_flight(requests: DataFrame, key: str, active_seconds: int) -> DataFrame:
    """The first request of an active period starts a job, later ones join it.

    From a start the next one is the first request of its key after the active
    time. These links are known for every request at once; the starts are those
    that the first request after an idle time leads to. ``event_id`` tells
    requests apart.
    """
    window_us = active_seconds * 1_000_000
    events = _events(requests, key, None)
    own = ["key_hash", "key_text"]
    heads = sessions(events, own, "us", "event_id", window_us, "session").where("__first").select(F.col("event_id").alias("id"))
    asked = events.select(*own, F.col("us").alias("at"), F.lit(0).alias("probe"), "event_id")
    probes = events.select(*own, (F.col("us") + window_us).alias("at"), F.lit(1).alias("probe"), "event_id")
    # at the same instant the request comes first: the job is still active then
    timeline = asked.unionByName(probes).withColumn("bucket", F.call_function("div", F.col("at"), F.lit(max(1, window_us // 16))))
    links = split_next(timeline, own, "bucket", ["at", "probe", "event_id"], F.col("probe") == 0, "event_id", "next").where(
        "probe = 1").select(F.col("event_id").alias("id"), "next")
    starts = reachable(links, heads).select(F.col("id").alias("event_id"), F.lit(True).alias("start"))
    return events.join(starts, "event_id", "left").select(
        F.col("key").alias(key), "event_id", F.when(F.col("start"), "started").otherwise("joined").alias("outcome"))


def _reserve(batches: Iterator[pa.RecordBatch], daily_limit: int) -> Iterator[pa.RecordBatch]:
    """Ids that fit, of days that come one after another, each in order; only the day's total is remembered."""
    day, total = None, 0
    for batch in batches:
        fits = []
        for own, units in zip(batch.column("usage_date").to_pylist(), batch.column("units").to_pylist(), strict=True):
            if own != day:
                day, total = own, 0
            fits.append(total + units <= daily_limit)
            total += units if fits[-1] else 0
        yield pa.RecordBatch.from_arrays([batch.column("event_id").filter(pa.array(fits, pa.bool_()))], ["event_id"])


def budget_reservations(reservations: DataFrame, daily_limit: int) -> DataFrame:
    """All-or-nothing reservations per day in (ts, event_id) order; what does not fit is skipped.

    What is left only shrinks, so the accepted reservations of one size are the
    first ones of that size, ``daily_limit / size`` of them at most. Only those
    candidates, however many reservations a day holds, pass by in order while
    the day's total is kept.
    """
    first = top_per_key(
        reservations.select("usage_date", "event_id", "ts", "units"), ["usage_date", "units"],
        [F.col("ts").asc(), F.col("event_id").asc()], daily_limit, rank="n"
    ).where(F.col("n") * F.col("units") <= daily_limit)
    in_order = first.select("usage_date", "units", "ts", "event_id").repartition("usage_date").sortWithinPartitions(
        "usage_date", "ts", "event_id")
    accepted = in_order.mapInArrow(lambda batches: _reserve(batches, daily_limit), _ddl(_types(reservations, "event_id")))
    return reservations.join(accepted.withColumn("ok", F.lit(True)), "event_id", "left").select(
        "usage_date", "event_id", "units", F.coalesce("ok", F.lit(False)).alias("reserved"))


def daily_cost(reserved: DataFrame) -> DataFrame:
    """Reserved units per day."""
    return reserved.where("reserved").groupBy(F.col("usage_date").alias("day")).agg(
        F.sum("units").alias("reserved_units"))


# Shared discoveries --------------------------------------------------------------------------

_START = ("us", "event_id", "user_id", "query_key")


def discovery_decisions(
    requests: DataFrame, active_seconds: int, fresh_seconds: int, user_limit: int, user_seconds: int, cap: int
) -> DataFrame:
    """Decision per discovery request (user_id, query_key, ts, event_id) in time order.

    joined: one for the query is running; reused: a finished one is still
    fresh; rate_limited: the user used up its starts; busy: ``cap`` discoveries
    are running; started: otherwise. Only starts leave a trace.

    At most ``cap`` starts fall into one slice of the active time. Against the
    starts before a slice, each query, user and occupancy level needs only its
    first few requests, so a slice's chain is found from a set bounded by the
    caps alone, and all other requests are decided by looking at the starts.
    """
    spark, path = requests.sparkSession, scratch_path(requests.sparkSession, "discovery")
    active, fresh, own = (n * 1_000_000 for n in (active_seconds, fresh_seconds, user_seconds))
    held = active + fresh
    asked = requests.select(_micros(F.col("ts")).alias("us"), "event_id", "user_id", "query_key")
    schema = _ddl(_types(asked, *_START))
    asked.withColumn("slice", F.expr(f"us div {active}")).write.partitionBy("slice").parquet(f"{path}/requests")
    stored = spark.read.schema(schema + ", slice bigint").parquet(f"{path}/requests")
    slices = [r[0] for r in stored.select("slice").distinct().orderBy("slice").toLocalIterator()]
    reach = max(held, own) // active + 1
    done: list[int] = []
    for number in slices:
        recent = [n for n in done if n >= number - reach]
        starts = (spark.read.schema(schema).parquet(*[f"{path}/starts/slice={n}" for n in recent])
                  if recent else spark.createDataFrame([], schema))
        here = stored.where(F.col("slice") == number).drop("slice")
        _discovery_starts(here, starts, active, held, user_limit, own, cap) \
            .write.parquet(f"{path}/starts/slice={number}")
        done.append(number)
    starts = spark.read.schema(schema).parquet(f"{path}/starts").select(*_START)
    return _discovery_outcomes(stored.drop("slice"), starts, active, held, user_limit, own)


def _discovery_starts(requests, starts, active, held, user_limit, own, cap) -> DataFrame:
    """Starts of one slice; ``starts`` holds at most ``cap`` rows per earlier slice in reach."""
    known = starts.agg(F.collect_list(F.struct("us", "user_id", "query_key"))).scalar()
    us = F.col("us")
    rows = requests.withColumn("s", known).where(~F.exists(
        "s", lambda x: (x["query_key"] == F.col("query_key")) & (x["us"] >= us - held))
    ).select(
        "us", "event_id", "user_id", "query_key",
        F.size(F.filter("s", lambda x: (x["user_id"] == F.col("user_id")) & (x["us"] >= us - own))).alias("mine"),
        F.size(F.filter("s", lambda x: x["us"] > us - active)).alias("running"),
    ).where((F.col("mine") < user_limit) & (F.col("running") < cap))
    in_time = [us.asc(), F.col("event_id").asc()]
    rows = top_per_key(rows, ["query_key", "user_id", "mine", "running"], in_time)
    rows = top_per_key(rows, ["user_id", "mine", "running"], in_time, cap + 1)
    rows = top_per_key(rows, ["query_key", "mine", "running"], in_time, cap + 1)
    rows = top_per_key(rows, ["running", "mine"], in_time, 2 * cap * (cap + 1) + cap + 1)
    order = F.array_sort(F.collect_list(F.struct("us", "event_id", "user_id", "query_key", "mine", "running")))
    empty = _no_entries(_types(requests, *_START))

    def step(new: Column, e: Column) -> Column:
        mine = e["mine"] + F.size(F.filter(new, lambda x: x["user_id"] == e["user_id"]))
        start = ((e["running"] + F.size(new) < cap) & (mine < user_limit)
                 & ~F.exists(new, lambda x: x["query_key"] == e["query_key"]))
        entry = F.struct(*[e[c].alias(c) for c in _START])
        return F.when(start, F.concat(new, F.array(entry))).otherwise(new)
    return rows.agg(order.alias("e")).select(F.inline(F.aggregate("e", empty, step)))


def _discovery_outcomes(requests, starts, active, held, user_limit, own) -> DataFrame:
    """All requests beside the starts that touch their query or user."""
    own_start = starts.select("event_id", F.lit(True).alias("started"))
    by_query = starts.select("query_key", F.col("us").alias("at"), F.col("event_id").alias("start_id"))
    before = (F.col("at") < F.col("us")) | ((F.col("at") == F.col("us")) & (F.col("start_id") < F.col("event_id")))
    same_query = requests.join(by_query, "query_key").where(before & (F.col("at") >= F.col("us") - held)).groupBy(
        "event_id").agg(F.bool_or(F.col("at") > F.col("us") - active).alias("is_running"))
    by_user = starts.select("user_id", F.col("us").alias("at"), F.col("event_id").alias("start_id"))
    same_user = requests.join(by_user, "user_id").where(before & (F.col("at") >= F.col("us") - own)).groupBy(
        "event_id").agg(F.count("*").alias("mine"))
    return (
        requests.join(own_start, "event_id", "left").join(same_query, "event_id", "left")
        .join(same_user, "event_id", "left")
        .select("event_id", "user_id", "query_key", F.when(F.col("started"), "started")
                .when(F.col("is_running"), "joined").when(F.col("is_running").isNotNull(), "reused")
                .when(F.coalesce("mine", F.lit(0)) >= user_limit, "rate_limited").otherwise("busy").alias("decision"))
    )
