"""Keyed building blocks that hold when one key owns a third of all rows.

* ``top_per_key`` ranks with a literal bound, so Catalyst prunes every map task
  to the bound before the shuffle (``WindowGroupLimit``).
* ``split_*`` functions cut a key's history at a bucket (a day, say): the work
  inside a bucket runs in its own task, and only one row per bucket is carried
  over the key. Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_SALT_ABOVE, _SALTS = 100, 32


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """First ``k`` rows per key in the given order; ``rank`` keeps the position column.

    Every map task sends at most ``k`` rows of a key on. For a large ``k`` a hot
    key would still bring together ``k`` rows of very many tasks, so there the
    key is first cut down in salted parts.
    """
    name = rank or "__position"
    if k > _SALT_ABOVE:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS))
        salted = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (df.withColumn("__salt", part).withColumn("__n", F.row_number().over(salted))
              .where(F.col("__n") <= k).drop("__salt", "__n"))
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def moved(df: DataFrame) -> DataFrame:
    """A table whose joins always move rows by key and never send it whole through the driver.

    For tables that open rows into several: Spark's estimate counts one row for
    each stored one, so it would broadcast a table many times the threshold.
    """
    return df.hint("merge")


def newest(*columns: str) -> list[Column]:
    """Descending order over a time column and its tie-breaking id."""
    return [F.col(c).desc() for c in columns]


def split_lag(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], carried: Sequence[str],
    prefix: str = "previous_",
) -> DataFrame:
    """``lag(1)`` of ``carried`` over ``keys`` ordered by ``order``.

    ``bucket`` must be a non-decreasing function of the order. Lag runs inside
    (keys, bucket); a bucket's first row takes the last row of the bucket before.
    """
    keys, order, carried = list(keys), list(order), list(carried)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    row = F.struct(*carried)
    last = df.groupBy(*keys, bucket).agg(
        F.max_by(row, F.struct(*order)).alias("__last"))
    over_buckets = Window.partitionBy(*keys).orderBy(bucket)
    before = last.select(*keys, bucket, F.lag("__last").over(over_buckets).alias("__before"))
    marked = (
        df.withColumn("__inside", F.lag(row).over(inside))
        .withColumn("__n", F.row_number().over(inside))
    )
    joined = marked.join(moved(before), [*keys, bucket])
    previous = F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__inside"))
    return joined.select(
        *df.columns, *[previous[c].alias(f"{prefix}{c}") for c in carried])


def split_running_sum(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Running sum of ``value`` over ``keys`` in ``order``, added up bucket by bucket."""
    keys, order = list(keys), list(order)
    rows = Window.unboundedPreceding, Window.currentRow
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(*rows)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, bucket, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    return (
        df.withColumn("__part", F.sum(value).over(inside))
        .join(offsets, [*keys, bucket])
        .select(*df.columns, (F.col("__part") + F.col("__offset")).alias(name))
    )


def split_row_number(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], name: str
) -> DataFrame:
    """Dense position over ``keys`` in ``order``, counted bucket by bucket."""
    return split_running_sum(df, keys, bucket, order, F.lit(1), name)
