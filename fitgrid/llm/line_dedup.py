"""Line deduplication: sorted hash ranges, first occurrences, per-document bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrid.llm.common import SPACE, ascii_lower, fingerprint, stored, whole

_BITS = 64


def line_keys(documents: DataFrame, min_chars: int) -> DataFrame:
    """Two 64-bit hashes of every long enough line key, with document and position; no text."""
    lines = documents.where(F.col("doc_id").isNotNull()).select(
        "doc_id", fingerprint(F.col("text")).alias("print"),
        F.posexplode(F.split(whole(), "\n", -1)).alias("pos", "line"))
    keyed = lines.select(
        "doc_id", "print", "pos", F.btrim("line", F.lit(SPACE)).alias("stripped")
    ).where(F.char_length("stripped") >= min_chars).withColumn("key", ascii_lower(F.col("stripped")))
    return keyed.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(97), "key").alias("h2"), "doc_id", "print", "pos")


def drop_bitmaps(documents: DataFrame, min_chars: int = 20, min_documents: int = 3) -> DataFrame:
    """``doc_id, print, words``: which lines of a document go.

    ``words`` maps word numbers to 64 bits; a set bit drops the line at
    64 * word + bit. Words without a set bit are left out, documents without
    one have no row.

    Hashes are range-partitioned by (hash, document descending), so the lines of
    one document that share a key stay together while a frequent key runs over
    as many ranges as it fills. Within a range rows are sorted by hash, document
    and position, so the first row of a key is its largest document there. Each
    range gives one row per key: that document and the number of holders. Only
    the first and the last key of a range can go on in another one; for these few
    keys, two per range, the rows of all ranges are put together. The result goes
    back to the holders by range and key, so the holders of a frequent line are
    spread over its ranges and no task ever gets all of them.
    """
    order = ["h1", "h2", F.col("doc_id").desc()]
    ranged = stored(line_keys(documents, min_chars), "line-keys").repartitionByRange(
        *order).sortWithinPartitions(*order, "pos").withColumn("range", F.spark_partition_id())
    holders = stored(ranged.groupBy("h1", "h2", "doc_id").agg(
        F.min("range").alias("range"), F.collect_list(F.struct("print", "pos")).alias("places")), "line-holders")
    in_range = stored(holders.groupBy("range", "h1", "h2").agg(
        F.max("doc_id").alias("first"), F.count("*").alias("n")), "line-ranges")
    key = F.struct("h1", "h2")
    ends = in_range.groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high")).select(
        F.explode(F.array("low", "high")).alias("key")).select("key.*").distinct()
    across = in_range.join(ends, ["h1", "h2"], "left_semi")
    whole_keys = across.groupBy("h1", "h2").agg(F.max("first").alias("first"), F.sum("n").alias("n"))
    repeated = in_range.join(ends, ["h1", "h2"], "left_anti").unionByName(
        across.select("range", "h1", "h2").join(whole_keys, ["h1", "h2"])
    ).where(F.col("n") >= min_documents).drop("n")
    dropped = holders.join(repeated, ["range", "h1", "h2"]).where(F.col("doc_id") < F.col("first")).select(
        "doc_id", F.explode("places").alias("place")).select(
        "doc_id", "place.print", F.floor(F.col("place.pos") / _BITS).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, cast(place.pos % {_BITS} as int))").alias("bit"))
    return (
        dropped.repartition("doc_id", "print")
        .groupBy("doc_id", "print", "word").agg(F.bit_or("bit").alias("bits"))
        .groupBy("doc_id", "print").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("words"))
    )


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_documents: int = 3) -> DataFrame:
    """All columns of ``documents`` with ``text`` cut down to its kept lines, plus ``n_lines, n_dropped``.

    A line's key is the line without white space at its ends and with A-Z
    lower-cased. Keys of ``min_chars`` code points or more that at least
    ``min_documents`` documents hold lose all their lines except in the largest
    doc_id. A null or empty text is one empty line. Rows without doc_id hold no
    key and keep all lines; rows that repeat a doc_id count as one document.
    Columns of these names that the input already has are replaced.
    """
    bitmaps = drop_bitmaps(documents.select("doc_id", "text"), min_chars, min_documents).select(
        F.col("doc_id").alias("__doc"), F.col("print").alias("__print"), F.col("words").alias("__words"))
    kept_columns = [c for c in documents.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = documents.select(*kept_columns, whole().alias("__text"), fingerprint(F.col("text")).alias("__p"))
    joined = rows.join(
        bitmaps, (F.col("doc_id") == F.col("__doc")) & (F.col("__p") == F.col("__print")), "left")
    lines = F.split("__text", "\n", -1)
    kept = F.expr(
        f"filter(split(__text, '\\n', -1), (line, i) -> (shiftrightunsigned(coalesce(element_at(__words, "
        f"cast(i div {_BITS} as int)), 0L), cast(i % {_BITS} as int)) & 1L) = 0)")
    return joined.select(
        *kept_columns,
        F.when(F.col("__words").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(F.map_values("__words"), F.lit(0).cast("long"), lambda n, bits: n + F.bit_count(bits)),
                   F.lit(0).cast("long")).alias("n_dropped"))
