"""Stored tables with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitgrid.schemas import RAW_TABLES


class UnknownColumns(ValueError):
    """The stored table has columns its schema does not name, or lacks some."""


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table by its declared schema; only the file footer is read to compare the columns."""
    path, schema = f"{directory}/{name}.parquet", RAW_TABLES[name]
    stored = set(spark.read.parquet(path).columns)
    if stored != set(schema.names):
        raise UnknownColumns(f"{name}: {sorted(stored ^ set(schema.names))}")
    return spark.read.schema(schema).parquet(path)


def load_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {name: load_table(spark, directory, name) for name in RAW_TABLES}


def spread(table: DataFrame, *keys: str, piece: int | None = None) -> DataFrame:
    """A stored table for work that costs far more than moving its rows.

    A table read in fewer pieces than there are cores is spread by its unique
    key; a large table already comes in many pieces and is left as it is.
    ``piece`` bounds the rows of a piece, for short rows from which much is made:
    a stored piece of them may hold millions. The rows are counted from the
    footers of the files.
    """
    wanted = table.sparkSession.sparkContext.defaultParallelism
    if piece:
        wanted = max(wanted, -(-table.count() // piece))
    return table.repartition(wanted, *keys) if table.rdd.getNumPartitions() < wanted else table
