"""Cutting long texts at natural breaks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentence ends, and the space before a list marker.
_SENTENCE_END = re.compile(r"(?<=[。！？!?])|(?<=[.;；])(?=\s)|\s(?=[■●◆▼・※↓【]|-\S)")
_SPACE = re.compile(r"\s")


def cut_points(text: str, limit: int) -> list[int]:
    """End offsets of the pieces, found by looking at one window of ``limit`` characters at a time."""
    ends, start = [], 0
    while len(text) - start > limit:
        cut = None
        for pattern in (_SENTENCE_END, _SPACE):
            for match in pattern.finditer(text, start + 1, min(len(text), start + limit + 2)):
                if match.start() > start + limit:
                    break
                cut = match.start()
            if cut is not None:
                break
        start = start + limit if cut is None else cut
        ends.append(start)
    ends.append(len(text))
    return ends


def bounded_chunks(documents: DataFrame, limit: int) -> DataFrame:
    """Documents → chunks of at most ``limit`` characters with stable ids; no visible character is lost.

    Only the cut offsets are found in Python; slicing, trimming and hashing stay in Spark.
    """
    @F.pandas_udf("array<int>")
    def ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: cut_points(t, limit))

    cuts = documents.withColumn(
        "ends", F.when(F.length("text") <= limit, F.array(F.length("text"))).otherwise(ends("text")))
    parts = cuts.select(
        "document_id", "text", F.posexplode(F.transform(
            "ends", lambda e, i: F.struct(
                F.when(i > 0, F.element_at("ends", F.when(i > 0, i).otherwise(1))).otherwise(0).alias("start"),
                e.alias("stop")))).alias("part", "span"))
    chunk = F.regexp_replace(
        F.expr("substring(text, span.start + 1, span.stop - span.start)"), r"^[\s　 ]+|[\s　 ]+$", "")
    return (
        parts.select("document_id", "part", chunk.alias("chunk")).where("chunk <> ''")
        .withColumn("chunk_id", F.sha2(F.concat_ws(
            "|", F.col("document_id").cast("string"), F.col("part").cast("string"), "chunk"), 256))
    )
