"""Source divergence audit: term counts by Arrow kernels, exact distances between the sources of a language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.llm.common import stored, whole
from fitgrid.llm.tokens import slices
from fitgrid.operators.keyed import top_per_key

NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between terms
_CHARS = 8_000_000  # of text in one Arrow step
_ROWS = 1_000_000  # partial counts that a task gathers before it sends them on
_CELLS = 1 << 15  # of one columnar shard: its terms times the sources of its language


def _counts(batch: pa.RecordBatch) -> pa.Table:
    """``place, term, count, docs``: per (lang, source) of the batch, by its place in the batch's list of them."""
    split = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=NO_TERM)
    row, term = pc.list_parent_indices(split), split.flatten()
    real = pc.not_equal(term, "")
    coded = term.filter(real).dictionary_encode()
    per_row = pa.table({"row": row.filter(real), "code": coded.indices}).group_by(
        ["row", "code"], use_threads=False).aggregate([([], "count_all")])
    summed = pa.table({
        "place": batch.column("place").take(per_row["row"]), "code": per_row["code"], "n": per_row["count_all"],
    }).group_by(["place", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    return pa.table({
        "place": summed["place"], "term": coded.dictionary.take(summed["code"]),
        "count": summed["n_sum"], "docs": summed["n_count"]})


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts, added up over its batches until they fill ``_ROWS`` rows."""
    places: dict[tuple[str, str], int] = {}
    waiting: list[pa.Table] = []

    def merged() -> pa.Table:
        found = pa.concat_tables(waiting).group_by(["place", "term"], use_threads=False).aggregate(
            [("count", "sum"), ("docs", "sum")])
        return found.rename_columns(["place", "term", "count", "docs"])

    def sent(found: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array(x, pa.string()) for x in zip(*places, strict=True))
        yield from pa.table({
            "lang": langs.take(found["place"]), "source": sources.take(found["place"]), "term": found["term"],
            "count": found["count"], "docs": found["docs"]}).to_batches(max_chunksize=50_000)

    for batch in batches:
        own = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        place = pa.array([places.setdefault(key, len(places)) for key in own], pa.int32())
        for part in slices(iter([pa.record_batch({"text": batch.column("text"), "place": place})]), chars=_CHARS):
            waiting.append(_counts(part))
            if sum(map(len, waiting)) > 2 * _ROWS:
                waiting = [merged()]
                if len(waiting[0]) > _ROWS:
                    yield from sent(waiting.pop())
    if waiting:
        yield from sent(merged())


def term_counts(documents: DataFrame, min_documents: int = 30) -> DataFrame:
    """``lang, source, term, count, lang_count``: occurrences of the terms in at least ``min_documents`` of a lang's texts.

    Tasks send partial counts, one row per term and source; they are dealt once,
    by lang and term, which serves the sum per source and the limit per lang.
    """
    texts = documents.select(*[whole(c).alias(c) for c in ("lang", "source", "text")])
    partial = texts.mapInArrow(_partial_counts, "lang string, source string, term string, count long, docs long")
    summed = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    return summed.select(
        "lang", "source", "term", "count", F.sum("count").over(own).alias("lang_count"),
        F.sum("docs").over(own).alias("lang_docs")).where(F.col("lang_docs") >= min_documents).drop("lang_docs")


def _share(count: Column, total: str, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * terms)), in whole numbers; null without terms."""
    wide = "decimal(19,0)"
    top = F.lit(scale).cast(wide) * (count + F.lit(smoothing)).cast(wide)
    below = F.col(total).cast(wide) + (F.lit(smoothing) * F.col("terms")).cast(wide)
    return F.when(F.col("terms") > 0, F.call_function("div", top, below) + 1)


def _distances(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Sums of absolute differences between all sources of one shard.

    Rows without a term give each source's share of a term it does not have.
    """
    term = table["term"].combine_chunks()
    absent = table.filter(pc.is_null(term))
    present = table.filter(pc.is_valid(term))
    names = absent["source"].combine_chunks()
    terms = present["term"].combine_chunks().dictionary_encode()
    shares = np.repeat(
        absent["p"].fill_null(0).to_numpy().astype(np.int64)[:, None], len(terms.dictionary), axis=1)
    shares[pc.index_in(present["source"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False),
           terms.indices.to_numpy()] = present["p"].to_numpy()
    lang = table["lang"][0]
    for i in range(len(names)):
        value = np.abs(shares - shares[i]).sum(axis=1)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.repeat(lang, len(names)), "source": pa.repeat(names[i], len(names)), "item": names,
            "value": pa.array(value, pa.int64())}).filter(pc.not_equal(names, names[i]))


def _shard(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _distances(pa.Table.from_batches(list(groups)))


def audit_sources(
    documents: DataFrame, min_documents: int = 30, smoothing: int = 5, scale: int = 10**9, top: int = 50,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the sources of each language lie from each other, and by what.

    Terms are runs of letters and of characters beyond ASCII, with A-Z
    lower-cased. A language keeps those in at least ``min_documents`` of its
    texts; every source of the language, and the language, gives each kept term
    the smoothed share ``p``, a whole number. Part ``pair`` holds, for every
    other source, the sum of ``|p - q|`` over the kept terms; part ``term`` the
    ``top`` terms of a source whose share lies furthest above the language's.
    Ranks go by value, largest first, then by item.

    Null texts, languages and sources count as empty. Sources without a kept
    term take part; a language without one has distances of 0. Repeated rows
    count each time. An empty table gives no rows. Other columns are not read.

    Distances are summed shard by shard: a shard holds the shares of a part of a
    language's terms for all its sources, and the number of shards follows the
    counted terms and sources. Only sums leave a shard.
    """
    counts = stored(term_counts(documents, min_documents), "term-counts")
    groups = documents.select(*[whole(c).alias(c) for c in ("lang", "source")]).distinct()
    in_group = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    in_lang = counts.groupBy("lang", "term").agg(F.max("lang_count").alias("n")).groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n").alias("lang_n"))
    own_lang = Window.partitionBy("lang")
    totals = stored(
        groups.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").select(
            "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms"),
            F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.count("*").over(own_lang).alias("sources")), "term-totals")

    cells = F.col("terms") * F.col("sources")
    shards = F.greatest(F.lit(1), F.ceil(cells / _CELLS)).cast("int")
    shared = counts.join(totals, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("count"), "n", smoothing, scale).alias("p"),
        _share(F.col("lang_count"), "lang_n", smoothing, scale).alias("q"),
        F.pmod(F.xxhash64("term"), shards).cast("int").alias("shard"))
    absent = totals.select(
        "lang", "source", F.lit(None).cast("string").alias("term"),
        _share(F.lit(0), "n", smoothing, scale).alias("p"),
        F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    pairs = (
        shared.select("lang", "source", "term", "p", "shard").unionByName(absent)
        .groupBy("lang", "shard").applyInArrow(_shard, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(
            Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))))
    terms = top_per_key(
        shared.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")),
        ["lang", "source"], [F.col("value").desc(), F.col("item")], top, "rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(columns))
