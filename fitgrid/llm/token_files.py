"""Token ids in Parquet: delta-coded list columns beside light metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitgrid.llm.tokens import crc32, encoder, slices

TOKENS = "doc_id long, part int, before long, n_tokens long, tokens array<int>"


def write_token_files(
    documents: DataFrame, path: str, vocabulary: str, end_id: int = 0,
    row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10,
) -> None:
    """Encode every whole text and write it in ascending doc_id order.

    Each row holds ``doc_id``, its file's number ``part``, the ids ``before`` it
    in that file, ``n_tokens`` (with the end id) and ``tokens``. Files are ranges
    of doc_id, sorted inside. Ids are delta-coded without a dictionary, the
    metadata columns dictionary-coded; row groups and pages have fixed target
    sizes and pages are indexed, so a reader takes single documents by doc_id,
    or metadata alone, without touching other ids. A null text is empty and
    holds the end id alone; rows that repeat a doc_id follow each other, each a
    document of its own; a null doc_id comes first.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, counts = words.ragged(batch.column("text"))
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(counts), part), pa.int32()),
                 pa.array(before + ends - counts), pa.array(counts), lists],
                ["doc_id", "part", "before", "n_tokens", "tokens"])
            before += int(ends[-1])

    ordered = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange(
        "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    (ordered.mapInArrow(encode, TOKENS).write
     .option("compression", "zstd").option("parquet.block.size", row_group_bytes)
     .option("parquet.page.size", page_bytes).option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#tokens.list.element", "false").parquet(path))


def token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` from the metadata columns alone; ids are not read."""
    rows = spark.read.schema("doc_id long, part int, before long, n_tokens long").parquet(path)
    return rows.join(_part_starts(rows), "part").select(
        "doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens")


def _part_starts(rows: DataFrame) -> DataFrame:
    """Ids in all files before each; the window sees one row per file."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            data = np.asarray(lists.values).astype("<u4").tobytes()
            at = np.asarray(lists.offsets).tolist()
            sums = [crc32(data[4 * a:4 * b]) for a, b in zip(at, at[1:])]
            counts = pa.array(np.diff(np.asarray(at, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("before"), counts,
                 pa.array(sums, pa.int64())],
                ["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    read = spark.read.schema(TOKENS).parquet(path)
    rows = read.mapInArrow(digest, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    starts = _part_starts(spark.read.schema("part int, n_tokens long").parquet(path))
    return rows.join(starts, "part").select(
        "doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
