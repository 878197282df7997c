"""Appending results once, in batch and in a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fitgrid.operators.ingest import new_rows


def _stored(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_new(
    df: DataFrame, path: str, key: Sequence[str], order: Sequence[Column], batch: str, buckets: int = 256,
) -> None:
    """Append rows whose natural key is not stored yet; the first of a key wins.

    Every batch owns a folder named after it and overwrites it, and compares
    only with the other batches, so a repeated or retried batch leaves the same
    rows. Rows are stored by a hash bucket of their key (``key_bucket``), and a
    batch reads the keys of its own buckets only: their numbers, ``buckets`` at
    most, are what the driver sees, and the scan is pruned by them. The number of
    buckets must stay the same for a path.
    """
    spread = df.withColumn("key_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    stored = _stored(spread.withColumn("batch", F.lit(batch)), path)
    if stored is None:
        known = df.select(*key).limit(0)
    else:
        own = [r[0] for r in spread.select("key_bucket").distinct().collect()]
        known = stored_keys(stored, key, own).where(F.col("batch") != batch).select(*key)
    new_rows(spread, known, key, order).repartition("key_bucket").write.mode("overwrite").partitionBy(
        "key_bucket").parquet(f"{path}/batch={batch}")


def stored_keys(stored: DataFrame, key: Sequence[str], buckets: Sequence[int]) -> DataFrame:
    """``key`` and ``batch`` of the rows in these buckets; files of other buckets are not opened."""
    return stored.where(F.col("key_bucket").isin(list(buckets))).select(*key, "batch")


def read_appended(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """All appended rows, without the columns that place them."""
    found = _stored(spark.createDataFrame([], schema), path)
    return spark.createDataFrame([], schema) if found is None else found.select(*schema.names)


def append_new_in_stream(path: str, key: Sequence[str], order: Sequence[Column]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for exactly-once results over micro-batches."""
    def write(df: DataFrame, batch_id: int) -> None:
        append_new(df, path, key, order, f"stream-{batch_id}")
    return write
