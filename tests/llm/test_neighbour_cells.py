"""The grid of query and candidate blocks grows with both, and results do not depend on it."""

import numpy as np

from fitgrid.llm import neighbours


def test_cells_grow_with_the_input():
    assert neighbours.cell_counts(0, 0, 131_072, 262_144, 8) == (1, 8)
    assert neighbours.cell_counts(400_000, 20_000_000, 131_072, 262_144, 8) == (4, 77)


def test_results_do_not_depend_on_the_grid(spark):
    x = np.random.default_rng(12).standard_normal((600, 12))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit[::10] @ unit.T
    close[np.arange(60), np.arange(0, 600, 10)] = -2
    want = {(10 * q, n + 1, int(v)) for q, row in enumerate(close) for n, v in enumerate(np.argsort(-row)[:5])}
    for grid in ({"query_blocks": 2, "candidate_blocks": 3}, {"query_blocks": 1, "candidate_blocks": 64}, {}):
        found = neighbours.nearest_neighbours(table, every=10, query_block=4, candidate_block=10, **grid).collect()
        assert {(r.query_id, r.rank, r.vec_id) for r in found} == want and len(found) == len(want)
