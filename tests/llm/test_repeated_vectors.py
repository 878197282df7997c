"""Vector searches over tables whose ids repeat, with equal and with different vectors."""

import itertools
from collections import defaultdict

import numpy as np
import pytest

from fitgrid.llm import neighbours, vector_dedup

SCHEMA = "vec_id long, embedding array<double>, score double, rank int, id long"


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 0.5, 1, 2) for i, v in rows], SCHEMA)


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.fixture(scope="module")
def rows():
    """Ids with one, several equal, and several different vectors, in clusters of near ones."""
    pick = np.random.default_rng(7)
    centres = pick.standard_normal((12, 10))
    out = [(int(i), centres[i % 12] + 0.08 * pick.standard_normal(10)) for i in range(160)]
    out += [(i, v) for i, v in out[::7]]  # equal rows
    out += [(i, centres[(i + 5) % 12]) for i in range(0, 160, 9)]  # other vectors of known ids
    out += [(50, out[7][1]), (50, out[7][1]), (7, out[7][1] * 2)]
    return out + [(200, None), (None, centres[0]), (250, np.zeros(10))]


def test_nearest_with_repeated_ids(spark, rows):
    held = defaultdict(list)
    for i, v in rows:
        if i is not None and v is not None and np.any(v):
            held[i].append(v)
    want = {}
    for q in (i for i in held if i % 50 == 0):
        near = {c: max(cosine(a, b) for a in held[q] for b in held[c]) for c in held if c != q}
        want[q] = sorted(near.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
    for blocks in ({"query_block": 3, "candidate_block": 5}, {"candidate_block": 64}, {}):
        got = defaultdict(list)
        for r in neighbours.nearest_neighbours(table_of(spark, rows), **blocks).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        for q, found in got.items():
            assert [(n, v) for n, v, _ in sorted(found)] == [(n, v) for n, (v, _) in enumerate(want[q], 1)]
            assert np.allclose([s for *_, s in sorted(found)], [s for _, s in want[q]])


def links_of(rows):
    points = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and np.any(v)})
    links, root = defaultdict(int), {i: i for i, _ in rows if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for (a, x), (b, y) in itertools.combinations(points, 2):
        if cosine(x, y) >= 0.95:
            links[a] += 1
            links[b] += 1
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return sorted((i, links[i], top(i), top(i) == i) for i, _ in rows if i is not None)


def test_links_with_repeated_ids(spark, rows):
    for size in ({"tables": 60, "bits": 5, "block": 8}, {"tables": 60, "bits": 5}):
        got = vector_dedup.near_duplicate_vectors(table_of(spark, rows), **size).collect()
        assert sorted(tuple(r) for r in got) == links_of(rows)


def test_two_vectors_of_one_id(spark):
    a, b = np.eye(4)[0], np.eye(4)[1]
    rows = [(3, a), (3, b), (5, b), (7, a + 0.1 * np.eye(4)[2])]
    got = vector_dedup.near_duplicate_vectors(table_of(spark, rows), tables=60, bits=4).collect()
    assert sorted(tuple(r) for r in got) == links_of(rows)
    assert {(r.vec_id, r.n_links) for r in got} == {(3, 2), (5, 1), (7, 1)}
    assert {r.component_id for r in got} == {3}


def test_bits_grow_with_the_points():
    assert vector_dedup.hash_sizes(0, 0.95, 0.001, 16)[1] == vector_dedup.hash_sizes(50_000, 0.95, 0.001, 16)[1] == 12
    for points in (10**6, 10**9, 10**12):
        tables, bits = vector_dedup.hash_sizes(points, 0.95, 0.001, 16)
        assert bits == 30 or points / 2**bits <= 16
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 0.001
