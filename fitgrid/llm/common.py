"""Small shared pieces: tables, written intermediate results, words, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrid.session import scratch_path

SPACE = " \t\n\x0b\f\r"  # the contract's white space, [\x20\x09-\x0D]
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage is cut and rows keep their ids."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: Column | str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(value: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that when every character is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(
        F.translate(value, upper, upper.lower()))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fingerprint(text: Column) -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(text)
