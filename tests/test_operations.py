"""Backlog counts and alert stretches against plain loops."""

import datetime as dt
import random
import re

import pytest

from fitgrid.operators import analytics, metrics

START = dt.datetime(2024, 1, 1)


def hour(n):
    return None if n is None else START + dt.timedelta(hours=n)


def runs(seed, n=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        queued = rng.randrange(1500)
        leased = rng.choice([None, queued, queued + rng.randrange(1, 60), queued - 3])
        lease = None if leased is None else leased + rng.randrange(0, 30)
        ended = rng.choice([None, (leased or queued) + rng.randrange(0, 90)])
        rows.append((i, *map(hour, (queued, leased, lease, ended))))
    return rows


SCHEMA = "job_id bigint, queued_at timestamp_ntz, leased_at timestamp_ntz, lease_until timestamp_ntz, ended_at timestamp_ntz"


@pytest.mark.parametrize("seed", [1, 2])
def test_backlog_equals_a_count_at_every_instant(spark, seed):
    rows = runs(seed)
    got = analytics.job_backlog(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()

    def waiting(t):
        return sum(q <= t and (leased or ended) is not None and (leased or ended) > t or q <= t and not leased and not ended
                   for _, q, leased, _, ended in rows)

    def expired(t):
        return sum(leased is not None and lease <= t and (ended is None or ended > t) for _, _, leased, lease, ended in rows)
    by_series = {name: {r.instant: r for r in got if r.series == name} for name in ("queued", "expired_lease")}
    for name, count in (("queued", waiting), ("expired_lease", expired)):
        value = 0
        for n in range(1800):
            r = by_series[name].get(hour(n))
            if r:
                assert r.open_jobs == value + r.entered - r.left
                value = r.open_jobs
            assert value == count(hour(n)), (name, n)
        assert any(r.left > r.entered for r in by_series[name].values())
    assert analytics.job_backlog(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sampled_stretches_equal_a_loop(spark):
    rng = random.Random(4)
    first = 86_400 * 19_000 - 3600
    breached = {(s, first + 60 * i) for s in ("a", "b") for i in range(3000) if rng.random() < 0.9}
    got = metrics.sampled_holds(spark.createDataFrame(sorted(breached), "series string, instant bigint").repartition(5), 60, 600)
    want = set()
    for s, t in breached:
        if (s, t - 60) not in breached:
            until = t
            while (s, until + 60) in breached:
                until += 60
            if until - t >= 600:
                want.add((s, dt.datetime.fromtimestamp(t, dt.UTC).replace(tzinfo=None), dt.datetime.fromtimestamp(until, dt.UTC).replace(tzinfo=None)))
    assert {tuple(r) for r in got.collect()} == want and want


def test_gauge_stretches_equal_a_loop(spark):
    rng = random.Random(7)
    rows = [(s, hour(t), rng.randrange(0, 8)) for s in ("a", "b") for t in sorted(rng.sample(range(3000), 400))]
    rows.append(("c", hour(5), 9))
    got = metrics.gauge_holds(spark.createDataFrame(rows, "series string, instant timestamp_ntz, value bigint").repartition(5), 3, 7200)
    want, open_ = set(), {}
    for s, t, v in sorted(rows):
        if v > 3:
            open_.setdefault(s, t)
        elif s in open_:
            since = open_.pop(s)
            if t - since >= dt.timedelta(hours=2):
                want.add((s, since, t))
    want |= {(s, since, None) for s, since in open_.items()}
    assert {tuple(r) for r in got.collect()} == want and ("c", hour(5), None) in want


def test_sliding_windows_hold_the_last_seconds(spark):
    rows = [(0, START), (1, START + dt.timedelta(seconds=1)), (2, START + dt.timedelta(seconds=60))]
    got = metrics.sliding(spark.createDataFrame(rows, "id bigint, ts timestamp_ntz"), 180, 60).collect()
    base = int(START.replace(tzinfo=dt.UTC).timestamp())
    assert {(r.id, r.instant - base) for r in got} == {
        (0, 0), (0, 60), (0, 120), (1, 60), (1, 120), (1, 180), (2, 60), (2, 120), (2, 180)}


def test_no_window_runs_over_a_whole_rule(spark):
    from fitgrid.bindings import Domain
    from fitgrid.plans.analytics import alert_hold
    plan = alert_hold(Domain(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    # windows over a series alone see the one row per day or month that is carried
    over_rows = [w for w in re.findall(r"Window \[(.*)", plan) if "windowspecdefinition(series" in w]
    assert over_rows
    for w in over_rows:
        keys = re.search(r"windowspecdefinition\(series#\d+, (\w+)", w).group(1)
        assert keys in ("day", "month"), w
