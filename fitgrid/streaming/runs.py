"""Starting streams over stored files and reading what they wrote."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrid.schemas import RAW_TABLES
from fitgrid.session import scratch_path

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, directory: str, name: str = "events") -> DataFrame:
    """The events as a stream; zone-free times become instants, which watermarks need.

    The bracket makes the path a pattern, which may name a single file or a folder of files.
    """
    rows = spark.readStream.schema(RAW_TABLES[name]).option("maxFilesPerTrigger", 64).parquet(
        f"{directory}/{name}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    """Settings a stream copies when it starts; the session keeps its own.

    On one machine a state store per core is enough, elsewhere the session's
    number of shuffle partitions stands.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB}
    if spark.sparkContext.master.startswith("local"):
        wanted["spark.sql.shuffle.partitions"] = str(spark.sparkContext.defaultParallelism)
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _run(stream: DataFrame, label: str, mode: str):
    """The finished query and the table it wrote."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, label)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", f"{path}/state")
    with _state_settings(spark):
        if mode == "append":
            query = writer.format("parquet").option("path", f"{path}/rows").start()
        else:
            def write(batch: DataFrame, batch_id: int) -> None:
                batch.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
            query = writer.foreachBatch(write).start()
        query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch_id", "long")
    return query, spark.read.schema(schema).parquet(f"{path}/rows")


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything stored now, exactly once, and read the table it wrote.

    State and output live in the shared folder, so a lost executor only repeats
    its own tasks. Outside append mode every batch owns one folder that a retry overwrites.
    """
    return _run(stream, label, mode)[1]


def run_and_count_dropped(stream: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As ``run_to_table``, with the number of rows that came behind the watermark."""
    query, table = _run(stream, label, "append")
    dropped = sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress for operator in progress["stateOperators"])
    return table, dropped
