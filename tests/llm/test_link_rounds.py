"""Rounds of components stop at stars, and sets move once per block of a region's tests."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from fitgrid.llm import components, jaccard


def test_stars_take_one_written_round(spark, monkeypatch):
    written, stored = [], components.stored

    def counted(df, label):
        written.append(label)
        return stored(df, label)
    monkeypatch.setattr("fitgrid.llm.components.stored", counted)
    links = [(9, i) for i in range(10, 40)] + [(50, 51), (51, 50), (7, 7)]
    found = {r.id: r.component for r in components.connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 9 for i in range(9, 40)} | {50: 50, 51: 50}
    assert len(written) == 1


def test_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    group = {i: i for pair in links if pair[0] != pair[1] for i in pair}
    for _ in range(300):
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    found = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in found} == group and len(found) == len(group)


def test_points_meet_pivots_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_BLOCK_POINTS", 4)
    monkeypatch.setattr(jaccard, "_BLOCK_PIVOTS", 2)
    rng = np.random.default_rng(5)
    sets = {i: np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for i in range(30)}
    home = {i: 0 if i < 20 else i for i in sets}  # one region of 20 points, ten of one
    pairs = [(i, j) for i, j in itertools.product(range(20), range(20, 30)) if (i + j) % 3]
    table = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "id long, hashes binary")
    regions = spark.createDataFrame([*home.items()], "id long, region long")
    sides = spark.createDataFrame([(0, j, j / 100) for j in range(20, 30)], "home long, other long, radius double").select(
        "home", "other", F.struct("radius").alias("q"))
    tested = spark.createDataFrame([(i, j, 0, 0.1) for i, j in pairs], "a long, b long, home long, d_home double")
    found = jaccard._point_distances(tested, sides, regions, table, "moved").collect()
    assert sorted((r.a, r.b) for r in found) == pairs
    for r in found:
        same = len(np.intersect1d(sets[r.a], sets[r.b]))
        union = len(np.union1d(sets[r.a], sets[r.b]))
        assert (r.home, r.d_home, r.r_other, r.same, r.all) == (0, 0.1, r.b / 100, same, union)
        assert r.d == 1 - same / union
