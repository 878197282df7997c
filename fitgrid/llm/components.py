"""Connected components of a link table, in rounds over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrid.llm.common import stored


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """``id, component`` (smallest id reachable) of every id that ``links`` (``a``, ``b``) names.

    Rounds of two star steps: every id sends its larger neighbours, then its
    smaller ones, to its smallest neighbour. Stars end up with the smallest id
    of their component in the middle, after a number of rounds that grows with
    the logarithm of the longest chain. Each round is written once to the shared
    folder, and one row of it reaches the driver: whether an id is not yet in a
    star. A hub's links are summed before they are shuffled, and its join can be
    split. A round names the links four times, however they are made: both ends
    of a link are opened from one row, since each further copy of the plan is
    planned and held by the driver.
    """
    edges = _ordered(links.select(F.col("a").cast("long"), F.col("b").cast("long")))
    while True:
        lowest = _both_ways(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _ordered(_both_ways(edges).where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # every row names the larger id first: b > a >= m
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("edge"))
        edges = stored(_ordered(small.select("edge.*")), label)
        if _stars(edges):
            break
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every edge runs from a larger id, which has no other, to one that has only such edges: its component's smallest."""
    roles = edges.select(F.col("a").alias("id"), F.lit(1).alias("n"), F.lit(0).alias("middle")).unionByName(
        edges.select(F.col("b").alias("id"), F.lit(0).alias("n"), F.lit(1).alias("middle")))
    open_ids = roles.groupBy("id").agg(F.sum("n").alias("n"), F.max("middle").alias("middle")).where("n + middle > 1")
    return open_ids.agg(F.count("*")).first()[0] == 0


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("edge")).select("edge.*")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()
