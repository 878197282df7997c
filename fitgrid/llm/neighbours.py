"""Nearest neighbours by int8 block products with error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.llm.vectors import cosine_rows, usable_vectors

_PACKED = "block int, ids binary, codes binary, scales binary, errors binary, vectors binary, dims int"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, one scale each, and the exact length of what rounding left out."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - codes * scale[:, None]
    return codes, scale, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def tile_bounds(qc, qs, qe, cc, cs, ce) -> tuple[np.ndarray, np.ndarray]:
    """Approximate cosines of a tile, and how far the true ones can be from them.

    For q = q' + e and c = c' + f: q.c - q'.c' = q'.f + e.c' + e.f, where
    |q'| <= 1 + |e|. Products of int8 codes are whole numbers, exact in float32
    below 2**24 and in float64 beyond.
    """
    kind = np.float32 if qc.shape[1] * 127 * 127 < 2**24 else np.float64
    product = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64)
    e, f = qe[:, None], ce[None, :]
    return product * qs[:, None] * cs[None, :], (1 + e) * f + e * (1 + f) + e * f + 1e-9


def _pack(vectors: DataFrame, per_block: int, blocks: str) -> DataFrame:
    """Vectors in blocks of at most ``per_block`` rows with codes, scales, errors and the originals."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, group in frame.groupby(frame["vector"].map(len)):
                for at in range(0, len(group), per_block):
                    part = group.iloc[at:at + per_block]
                    x = np.stack(part["vector"].to_numpy()).astype(np.float64)
                    codes, scale, error = quantise(x)
                    ids = part["vec_id"].to_numpy(np.int64)
                    yield pd.DataFrame([(int(ids[0] % 1_000_003), ids.tobytes(), codes.tobytes(), scale.tobytes(),
                                         error.tobytes(), x.tobytes(), x.shape[1])],
                                       columns=["block", "ids", "codes", "scales", "errors", "vectors", "dims"])
    packed = vectors.mapInPandas(work, _PACKED)
    return packed.select(*[F.col(c).alias(f"{blocks}_{c}") for c in packed.columns])


def _unpack(row: dict, side: str) -> tuple:
    n = row[f"{side}_dims"]
    return (np.frombuffer(row[f"{side}_ids"], np.int64),
            np.frombuffer(row[f"{side}_codes"], np.int8).reshape(-1, n),
            np.frombuffer(row[f"{side}_scales"], np.float64), np.frombuffer(row[f"{side}_errors"], np.float64),
            np.frombuffer(row[f"{side}_vectors"], np.float64).reshape(-1, n))


def nearest_in_tile(query: tuple, candidate: tuple, k: int) -> Iterator[tuple[int, int, float]]:
    """The k best candidates of each query in a tile, exactly, ties to the smaller id.

    The k-th largest lower bound rules out every candidate whose upper bound is
    smaller; the pairs that are left are computed again in double precision.
    """
    qi, qc, qs, qe, qx = query
    ci, cc, cs, ce, cx = candidate
    near, slack = tile_bounds(qc, qs, qe, cc, cs, ce)
    low = near - slack
    low[qi[:, None] == ci[None, :]] = -np.inf
    by_id = np.argsort(ci, kind="stable")
    first = np.flatnonzero(np.diff(ci[by_id], prepend=ci[by_id[0]] - 1))
    if len(first) < len(ci):  # an id counts once, by its nearest row
        low = np.maximum.reduceat(low[:, by_id], first, axis=1)
    least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(qi), -np.inf)
    rows, columns = np.nonzero(near + slack >= least[:, None])
    other = qi[rows] != ci[columns]
    rows, columns = rows[other], columns[other]
    for at in range(0, len(rows), 200_000):
        part = slice(at, at + 200_000)
        score = cosine_rows(qx[rows[part]], cx[columns[part]])
        yield from zip(rows[part].tolist(), ci[columns[part]].tolist(), score.tolist(), strict=True)


def cell_counts(queries: int, candidates: int, query_rows: int, candidate_rows: int, least: int) -> tuple[int, int]:
    """Groups of query blocks and of candidate blocks of about so many rows each; at least ``least`` of the latter."""
    return max(1, -(-queries // query_rows)), max(least, -(-candidates // candidate_rows))


def nearest_neighbours(
    embeddings: DataFrame, every: int = 50, k: int = 5, query_block: int = 1024, candidate_block: int = 4096,
    tile_splits: int = 8, query_blocks: int = 128, candidate_blocks: int = 64,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest cosine for each row whose id ``every`` divides.

    Exact: int8 tile products only sort out what cannot be among the k best.
    Query blocks and candidate blocks meet by an equal join on a grid cell, so
    each pair of blocks is one row of work and a cell can be any task. A cell has
    about ``query_blocks`` by ``candidate_blocks`` full blocks, and there are at
    least ``tile_splits`` cells, so the grid grows with the input and the work of
    a cell does not. Within a task a heap of k per query merges its tiles; a task
    that holds the heaps of a cell's queries sends them on before it takes more.
    All heaps are merged by rank. An id that several rows hold, equal or not, is
    one query and one candidate: two ids are as near as the nearest of their
    rows. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor rows without id; vectors of other
    lengths are compared among themselves only.
    """
    vectors = usable_vectors(embeddings)
    queries = _pack(vectors.where(F.col("vec_id") % every == 0), query_block, "q")
    heaps_at_once = query_blocks * query_block
    n = vectors.agg(F.count_if(F.col("vec_id") % every == 0).alias("queries"), F.count("*").alias("candidates")).first()
    across, down = cell_counts(
        n["queries"], n["candidates"], heaps_at_once, candidate_blocks * candidate_block, tile_splits)

    def dealt(blocks: DataFrame, ids: str, own: tuple[str, int], other: tuple[str, int]) -> DataFrame:
        """Each block in one group of its side, and with every group of the other side."""
        return blocks.withColumn(own[0], F.pmod(F.xxhash64(ids), F.lit(own[1])).cast("int")).withColumn(
            other[0], F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1))))
    rows, columns = ("cell_q", across), ("cell_c", down)
    candidates = dealt(_pack(vectors, candidate_block, "c"), "c_ids", columns, rows)
    tiles = dealt(queries, "q_ids", rows, columns).join(candidates, ["cell_q", "cell_c"]).where("q_dims = c_dims")

    def best_of(heaps: dict[int, list]) -> pd.DataFrame:
        return pd.DataFrame([(q, -v, s) for q, heap in heaps.items() for s, v in heap], columns=["query_id", "vec_id", "score"])

    def offer(heap: list, entry: tuple[float, int]) -> None:
        """Keep the k best entries, one per id."""
        if len(heap) == k and entry <= heap[0]:
            return
        for i, (score, vec) in enumerate(heap):
            if vec == entry[1]:
                if score < entry[0]:
                    heap[i] = entry
                    heapq.heapify(heap)
                return
        if len(heap) < k:
            heapq.heappush(heap, entry)
        else:
            heapq.heapreplace(heap, entry)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list] = {}
        for frame in frames:
            for row in frame.to_dict("records"):
                if len(heaps) >= heaps_at_once:
                    yield best_of(heaps)
                    heaps = {}
                query, candidate = _unpack(row, "q"), _unpack(row, "c")
                for i, vec, score in nearest_in_tile(query, candidate, k):
                    offer(heaps.setdefault(int(query[0][i]), []), (score, -vec))
        if heaps:
            yield best_of(heaps)

    best = tiles.mapInPandas(work, "query_id long, vec_id long, score double").groupBy(
        "query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
