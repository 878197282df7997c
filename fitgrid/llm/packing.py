"""Packing token pieces into windows by non-negative least squares over a length histogram."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.llm.common import stored
from fitgrid.llm.tokens import crc32, encoder, slices
from fitgrid.operators.keyed import split_running_sum

_ENCODED = ("doc_id long, part int, row long, doc_tokens long, n_full long, full_before long, "
            "rest_len int, rank_in_part long, full_crcs array<long>, rest binary")


def fill_combinations(histogram: dict[int, int], window: int, frequent: int = 96) -> list[tuple[int, ...]]:
    """Shallow combinations of present lengths that fill the window exactly.

    All pairs, and all triples that hold two of the most frequent lengths.
    """
    lengths = sorted(histogram)
    found = {(a, window - a) for a in lengths if a <= window - a and window - a in histogram}
    top = sorted(lengths, key=lambda n: (-histogram[n], n))[:frequent]
    for i, a in enumerate(top):
        for b in top[i:]:
            if window - a - b in histogram:
                found.add(tuple(sorted((a, b, window - a - b))))
    return sorted(found)


def solve_repeats(
    combinations: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = 60,
) -> list[int]:
    """Whole repeat counts: non-negative least squares against the histogram by coordinate descent, then rounded.

    Rounding goes down to what the histogram still holds, largest counts first,
    so no length is used more often than it occurs.
    """
    parts = [list(Counter(c).items()) for c in combinations]
    norms = [sum(m * m for _, m in p) for p in parts]
    left = {n: float(count) for n, count in histogram.items()}
    x = [0.0] * len(parts)
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(parts):
            step = max(-x[j], sum(m * left[n] for n, m in p) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, m in p:
                    left[n] -= m * step
        if moved < 0.01:
            break
    free, counts = dict(histogram), [0] * len(parts)
    for j in sorted(range(len(parts)), key=lambda j: (-x[j], j)):
        counts[j] = max(0, min(int(x[j] + 0.5), min(free[n] // m for n, m in parts[j])))
        for n, m in parts[j]:
            free[n] -= m * counts[j]
    return counts


def allocate(combinations: list[tuple[int, ...]], counts: list[int]) -> tuple[list[tuple], int]:
    """Rows ``(length, first rank, end rank, offset, first sequence)`` and the number of sequences."""
    rows, used, sequence = [], Counter(), 0
    for lengths, n in zip(combinations, counts, strict=True):
        offset = 0
        for length in lengths if n else ():
            rows.append((length, used[length], used[length] + n, offset, sequence))
            used[length] += n
            offset += length
        sequence += n
    return rows, sequence


def pack_documents(
    documents: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each document is encoded once with ``end_id`` behind it. Whole windows of
    it are sequences of their own. What is left, shorter than a window, enters
    the histogram (at most ``window - 1`` counts, all that comes to the driver).
    Combinations that fill a window are repeated as the least squares say, and
    take the pieces of a length by rank. The residual pieces are laid end to end
    and cut at every window, so only the very last sequence needs padding.

    Ranks and positions are summed per stored part and then over parts, so a
    length that a third of all documents share is nobody's single task. Null or
    empty texts hold the end id alone; repeated rows are packed one by one; an
    empty table gives no pieces.
    """
    spark = documents.sparkSession
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, row, full_before = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        ranks: Counter = Counter()
        for batch in slices(batches):
            out = []
            for ids in words.encode(batch.column("text")):
                ids += end
                n = len(ids) // 4
                whole = n // window
                rest = ids[4 * whole * window:]
                out.append((part, row, n, whole, full_before, n - whole * window, ranks[n - whole * window],
                            [crc32(ids[4 * i * window:4 * (i + 1) * window]) for i in range(whole)],
                            np.frombuffer(rest, "<u4").astype("<u2").tobytes() if len(words.begins[" "]) <= 65536
                            and end_id < 65536 else rest))
                ranks[n - whole * window] += 1
                row, full_before = row + 1, full_before + whole
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                     pa.list_(pa.int64()), pa.binary()]
            names = [x.split()[0] for x in _ENCODED.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]],
                names)

    encoded = stored(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _ENCODED), "pack")
    light = encoded.select("part", "row", "n_full", "full_before", "rest_len", "rank_in_part")
    histogram = {r["rest_len"]: r["count"] for r in light.where("rest_len > 0").groupBy("rest_len").count().collect()}
    combinations = fill_combinations(histogram, window)
    rows, n_filled = allocate(combinations, solve_repeats(combinations, histogram))
    slots = spark.createDataFrame(
        rows, "slot_len int, lo long, hi long, slot_offset long, slot_sequence long")  # at most three rows a combination

    earlier = Window.partitionBy("rest_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = light.groupBy("rest_len", "part").count().select(
        "rest_len", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    earlier_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full_bases = light.groupBy("part").agg(F.sum("n_full").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier_parts), F.lit(0)).alias("full_base"))
    ranked = light.join(bases, ["rest_len", "part"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    placed = ranked.join(F.broadcast(slots), (F.col("rest_len") == F.col("slot_len")) & (
        F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").select(
        "part", "row", "rest_len", (F.col("slot_sequence") + F.col("rank") - F.col("lo")).alias("sequence"),
        "slot_offset")
    placed = stored(placed, "placed")
    residual = split_running_sum(
        placed.where(F.col("sequence").isNull() & (F.col("rest_len") > 0)), [], "part", ["row"],
        F.col("rest_len"), "laid").select("part", "row", (F.col("laid") - F.col("rest_len")).alias("laid"))
    n_laid = placed.where(F.col("sequence").isNull()).agg(F.sum("rest_len")).first()[0] or 0
    first_full = n_filled + -(-n_laid // window)
    plan = placed.join(residual, ["part", "row"], "left").drop("rest_len")
    joined = encoded.join(plan, ["part", "row"]).join(full_bases, "part").select(
        "doc_id", "doc_tokens", "full_crcs", "rest_len", "rest", "sequence", "slot_offset", "laid",
        (F.lit(first_full) + F.col("full_base") + F.col("full_before")).alias("full_sequence"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                doc, n = r["doc_id"], r["doc_tokens"]
                for i, crc in enumerate(r["full_crcs"]):
                    out.append((doc, i * window, window, crc, n, r["full_sequence"] + i, 0))
                left = r["rest_len"]
                if not left:
                    continue
                wide = len(r["rest"]) // left
                ids = np.frombuffer(r["rest"], f"<u{wide}").astype("<u4").tobytes()
                begin = n - left
                if r["sequence"] is not None:
                    out.append((doc, begin, left, crc32(ids), n, r["sequence"], r["slot_offset"]))
                    continue
                at = 0
                while at < left:
                    sequence, offset = divmod(r["laid"] + at, window)
                    size = min(left - at, window - offset)
                    out.append((doc, begin + at, size, crc32(ids[4 * at:4 * (at + size)]), n,
                                n_filled + sequence, offset))
                    at += size
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return joined.mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
