"""Near-duplicate embeddings: random-hyperplane tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrid.llm.common import stored
from fitgrid.llm.components import connected_components
from fitgrid.llm.vectors import usable_vectors


def _signed(vectors: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """One row per vector and table: ``id, size, vector, keys, table, key``."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for frame in frames:
            for dims, part in frame.groupby(frame["vector"].map(len)):
                if dims not in planes:
                    planes[dims] = np.random.default_rng([seed, dims]).standard_normal((dims, tables * bits))
                for at in range(0, len(part), 2048):
                    rows = part.iloc[at:at + 2048]
                    x = np.stack(rows["vector"].to_numpy())
                    signs = (x @ planes[dims] >= 0).reshape(len(x), tables, bits)
                    keys = (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                    yield pd.DataFrame({"id": rows["id"], "size": rows["size"],
                                        "vector": [v.astype("<f8").tobytes() for v in x],
                                        "keys": [k.tobytes() for k in keys]})
    made = vectors.mapInPandas(work, "id long, size long, vector binary, keys binary")
    return made


def tile_links(left: pd.DataFrame, right: pd.DataFrame | None, table: int, threshold: float):
    """Linked pairs of a tile as index arrays; a pair counts only in the first table that brings it together."""
    def read(side):
        x = np.frombuffer(b"".join(side["vector"]), "<f8").reshape(len(side), -1)
        keys = np.frombuffer(b"".join(side["keys"]), np.int32).reshape(len(side), -1)
        return x, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], keys
    x, ux, kx = read(left)
    y, uy, ky = (x, ux, kx) if right is None else read(right)
    i, j = np.nonzero(ux @ uy.T >= threshold - 1e-9)
    if right is None:
        i, j = i[i < j], j[i < j]
    fresh = np.ones(len(i), bool)
    for t in range(table):
        fresh &= kx[i, t] != ky[j, t]
    i, j = i[fresh], j[fresh]
    if len(i):
        exact = np.empty(len(i))
        for at in range(0, len(i), 100_000):
            a, b = x[i[at:at + 100_000]], y[j[at:at + 100_000]]
            exact[at:at + 100_000] = np.einsum("ij,ij->i", a, b) / (
                np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        i, j = i[exact >= threshold], j[exact >= threshold]
    return i, j


def _runs(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Sorted frames cut anew, so that rows of one key stand in one frame; the last key of a frame waits for the next."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame[key].to_numpy() == frame[key].iloc[-1]
        if rest and rest[0][key].iloc[0] == frame[key].iloc[-1]:
            rest.append(frame)
            continue
        yield pd.concat([*rest, frame[~last]])
        rest = [frame[last]]
    if rest:
        yield pd.concat(rest)


def _tile_rows(left: pd.DataFrame, right: pd.DataFrame | None, table: int, threshold: float) -> tuple[np.ndarray, ...]:
    """(id, n, root) per linked vector of the tile: copies linked here, and the smallest vector it hangs together with here."""
    i, j = tile_links(left, right, table, threshold)
    if not len(i):
        return (np.zeros(0, np.int64),) * 3
    ids = left["id"].to_numpy() if right is None else np.concatenate((left["id"], right["id"]))
    sizes = left["size"].to_numpy() if right is None else np.concatenate((left["size"], right["size"]))
    if right is not None:
        j = j + len(left)
    count = np.bincount(i, sizes[j], len(ids)) + np.bincount(j, sizes[i], len(ids))
    root = ids.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    some = np.flatnonzero(count)
    return ids[some], count[some].astype(np.int64), root[some]


def hash_sizes(points: int, threshold: float, missed: float, per_bucket: int) -> tuple[int, int]:
    """(tables, bits): buckets of about ``per_bucket`` unrelated points, and tables enough to miss a share of ``missed``.

    Twelve bits at least and thirty at most. A pair at the threshold agrees on a
    bit with probability 1 - arccos(threshold) / pi.
    """
    bits = min(30, max(12, math.ceil(math.log2(max(1, points) / per_bucket))))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(missed) / math.log1p(-meets)), bits


def near_duplicate_vectors(
    embeddings: DataFrame, threshold: float = 0.95, missed: float = 0.001, per_bucket: int = 16, block: int = 1024, seed: int = 5,
    tables: int | None = None, bits: int | None = None,
) -> DataFrame:
    """One row per row with an id: ``vec_id, n_links, component_id, kept``.

    Equal vectors become one point with a size, so a group of copies costs
    nothing. Each table cuts space by random hyperplanes, whose number grows
    with the logarithm of the points, so unrelated points per bucket do not; the
    number of tables follows from the share of pairs at the threshold that may
    be ``missed``; both can be given instead. Buckets are dealt out in blocks of about ``block`` points and
    tiles of two blocks, so a full bucket is many tasks, and tiles are read off
    sorted partitions, many small ones in one pass. A tile computes all cosines
    in double precision and returns one row per linked point: how many copies it
    links to, and the smallest point of its group here. No pairs leave a tile. A
    pair that meets in several tables counts in the first.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths never link. Rows that repeat
    a vec_id are one vector if equal. If they differ, each is a vector of its
    own: the id's rows add up their links, and through the id their groups are
    one. Rows without id are left out.
    """
    good = usable_vectors(embeddings)
    classes = stored(good.groupBy("vector").agg(
        F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("size")
    ).withColumn("id", F.monotonically_increasing_id()), "vectors")
    own = stored(good.join(classes, "vector").select("vec_id", "id", "size", "first").distinct(), "vector-points")
    sizes = hash_sizes(classes.count(), threshold, missed, per_bucket)
    tables, bits = tables or sizes[0], bits or sizes[1]
    signed = stored(_signed(classes.select("id", "size", "vector"), tables, bits, seed), "signed")
    rows = signed.select("id", "size", "vector", "keys", F.posexplode(F.expr(
        f"transform(sequence(0, {tables - 1}), t -> hex(substring(keys, 4 * t + 1, 4)))")).alias("table", "key"))
    rows = rows.withColumn("dims", F.length("vector"))
    keys = signed.select("id", F.length("vector").alias("dims"), F.posexplode(F.expr(
        f"transform(sequence(0, {tables - 1}), t -> hex(substring(keys, 4 * t + 1, 4)))")).alias("table", "key"))
    full = keys.groupBy("dims", "table", "key").agg(F.count("*").alias("m")).where("m > 1").select(
        "dims", "table", "key", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    dealt = rows.join(full, ["dims", "table", "key"]).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "id", "size", "vector", "keys", "table", "part",
        F.concat_ws("/", "dims", "table", "key", F.least("part", "other"), F.greatest("part", "other")).alias("tile"),
        (F.col("part") > F.col("other")).alias("second"), (F.col("part") == F.col("other")).alias("alone"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _runs(frames, "tile"):
            ends = np.flatnonzero(np.diff(pd.factorize(frame["tile"])[0], append=-1)) + 1
            found = []
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                tile = frame.iloc[begin:end]
                table, side = int(tile["table"].iloc[0]), tile["second"].to_numpy()
                if tile["alone"].iloc[0]:
                    found.append(_tile_rows(tile, None, table, threshold))
                elif side.any() and not side.all():
                    found.append(_tile_rows(tile[~side], tile[side], table, threshold))
            if found:
                yield pd.DataFrame({name: np.concatenate([x[i] for x in found]) for i, name in enumerate(("id", "n", "root"))})

    found = stored(tiles.repartition("tile").sortWithinPartitions("tile").mapInPandas(
        work, "id long, n long, root long"), "tiles")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    shared = own.groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a < most")
    same_id = own.join(shared, "vec_id").select("a", F.col("id").alias("b"))
    groups = connected_components(
        found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(same_id), "vector-links")
    placed = own.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = placed.join(counts, "id", "left").join(smallest, "component").groupBy("vec_id").agg(
        F.sum(F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.min("component_id").alias("component_id"))
    return embeddings.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long")).join(
        linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))
