"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.llm.common import stored, whole, word_count
from fitgrid.operators.keyed import split_running_sum


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
) -> DataFrame:
    """One row per source: ``source, source_no, source_size, target, budget``.

    Sources stand in code point order, null last, and take the weights in turn.
    Together they get ``share`` of all words; a target stops at ``limit`` times
    its source's size and the excess is shared again by weight. That is one
    water level: with sources in the order of ``cap / weight``, the first level
    that leaves its own source below its cap holds for all that follow (later
    ones are lower, so it is the largest such level).
    These windows see one row per source, never a document.
    """
    everything = Window.partitionBy()
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (
        ranked.withColumn("w", F.element_at(cycle, (F.col("source_no") - 1) % len(weights) + 1))
        .withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
        .withColumn("all_words", F.lit(float(share)) * F.sum("source_size").over(everything))
    )
    upward = Window.orderBy((F.col("cap") / F.col("w")), "source_no")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    onward = upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levelled = weighed.withColumn("own_level", level).withColumn(
        "level", F.max(F.when(F.col("own_level") <= F.col("cap") / F.col("w"), F.col("own_level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("w") * F.col("level")))
    return levelled.withColumn("target", target).select(
        "source", "source_no", "source_size", "target", F.sum(target).over(everything).alias("budget"))


def mix_sources(
    documents: DataFrame, keep: Sequence[str] = ("doc_id",), weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5, limit: float = 2.0, seed: int = 11, prefix: str = "", slice_rows: int = 65_536,
) -> DataFrame:
    """Every document with ``size, source_size, target, times, taken``; ``keep`` names the columns carried along.

    The five names carry ``prefix``; a kept column that still has one of them
    gives way to it.

    Documents of a source are shuffled by a hash of their id and queue up once
    per round (``ceil(limit)`` rounds). A document's virtual finish time is the
    number of source words queued up to its end, divided by the source's target.
    All entries are then sorted by finish time and taken until the budget, the
    sum of the targets, is used up. Fair queueing serves the same number of
    words per unit of virtual time, so equal slices of that time are an even
    range partitioning; queues are summed over slices of the hash range, so a
    source with a third of all rows is spread over many tasks. There are 1,024
    slices at least, and one per ``slice_rows`` documents, and four times as many
    slices of time. The choice does not depend on their number.

    The choice depends on the documents alone, so reruns agree. Null or empty
    texts have size 0 and are never taken; a null source is a source of its own;
    repeated rows queue up one by one. An empty table gives no rows.
    """
    rounds = int(-(-limit // 1))
    made = [prefix + c for c in ("size", "source_size", "target", "times", "taken")]
    keep = [c for c in keep if c not in made]
    base = stored(
        documents.select(
            *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "source",
            word_count(whole()).alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("pick"),
            F.monotonically_increasing_id().alias("row")), "mix")
    bits = max(10, math.ceil(math.log2(max(1, base.count() / slice_rows))))
    targets = source_targets(base, weights, share, limit)
    known = base.select("source", "size", "pick", "row").alias("b").join(
        targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "source_no", "source_size", "target", "budget", "size", "pick", "row")
    queued = split_running_sum(
        known.where("size > 0").withColumn("slice", F.shiftright("pick", 64 - bits)),
        ["source_no"], "slice", ["pick", "row"], F.col("size"), "queued")
    entries = queued.withColumn(
        "round", F.explode(F.array(*[F.lit(i) for i in range(rounds)]))
    ).withColumn("finish", (F.col("round") * F.col("source_size") + F.col("queued")) / F.col("target")
    ).withColumn("tick", F.floor(F.col("finish") * (4 << bits)))
    served = split_running_sum(
        entries, [], "tick", ["finish", "source_no", "pick", "row", "round"], F.col("size"), "served")
    times = served.where(F.col("served") <= F.col("budget")).groupBy("row").agg(F.count("*").alias("times"))
    n = F.coalesce(F.col("times"), F.lit(0))
    facts = base.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "b.*", "source_size", "target")
    return facts.join(times, "row", "left").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        *[c.alias(name) for c, name in zip(
            (F.col("size"), F.col("source_size"), F.col("target"), n, n * F.col("size")), made, strict=True)])
