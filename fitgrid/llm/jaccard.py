"""Exact Jaccard components of documents in metric space: min-hash pivots, regions, prefix filter, one pass over boundary points."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.llm.common import fingerprint, stored
from fitgrid.llm.components import connected_components
from fitgrid.llm.shingles import shingle_set
from fitgrid.llm.tokens import text_batches

_NOBODY = 65535
_BATCH_HASHES = 500_000
_BLOCK_POINTS, _BLOCK_PIVOTS = 128, 32
_SLACK = 1e-9


def _census(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """``doc_id, print, n, n_alone`` of rows ``doc_id, print, text`` or ``doc_id, print, hashes``.

    That is the size of a set, and how many of its shingles no other row has.

    Each batch of texts sends one packed row per bucket of shingle hashes, with
    the number of the document in the batch beside each hash. A shingle that the
    batch holds more than once goes without a number, so even one that every
    document has takes one entry per batch. Back come counts by batch and
    document number; the ids wait in a row of their own.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() << 32
        for batch, values in _value_batches(batches):
            ids, prints = (np.asarray(batch.column(c), np.int64) for c in ("doc_id", "print"))
            for at in range(0, len(values), _NOBODY):
                sets = [np.frombuffer(v, np.uint64) if isinstance(v, bytes) else shingle_set(v, width)
                        for v in values[at:at + _NOBODY]]
                sizes = np.asarray([len(s) for s in sets], np.int64)
                owner = np.repeat(np.arange(len(sets)), sizes)
                kinds, first, count = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
                owner = np.where(count == 1, owner[first], _NOBODY).astype(np.uint16)
                place = ((kinds >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((owner, place))
                cuts = np.searchsorted(place[order], np.arange(buckets + 1))
                low, owner = kinds.astype(np.uint32)[order], owner[order]
                made = [(b, turn, low[x:y].tobytes(), owner[x:y].tobytes(), None)
                        for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
                head = np.concatenate((ids[at:at + _NOBODY], prints[at:at + _NOBODY], sizes)).tobytes()
                made.append((turn % buckets, turn, b"", b"", head))
                turn += 1
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*made), kinds, strict=True)],
                    ["bucket", "batch", "hashes", "owners", "head"])

    def alone(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["hashes"]])
        owners = np.concatenate([np.frombuffer(x, np.uint16) for x in frame["owners"]])
        _, first, count = np.unique(hashes, return_index=True, return_counts=True)
        single = np.zeros(len(hashes), bool)
        single[first[count == 1]] = True
        ends = np.cumsum([len(x) // 4 for x in frame["hashes"]])
        hits = []
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            part = owners[begin:end][single[begin:end]]
            hits.append(np.bincount(part[part != _NOBODY]).astype("<u4").tobytes())
        return pd.DataFrame({"batch": frame["batch"], "hits": hits, "head": frame["head"]})

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        ids, prints, sizes = np.frombuffer(frame["head"].dropna().iloc[0], np.int64).reshape(3, -1)
        n_alone = np.zeros(len(ids), np.int64)
        for x in frame["hits"]:
            hits = np.frombuffer(x, "<u4")
            n_alone[:len(hits)] += hits
        return pd.DataFrame({"doc_id": ids, "print": prints, "n_alone": n_alone, "n": sizes})

    packed = rows.mapInArrow(spread, "bucket int, batch long, hashes binary, owners binary, head binary")
    hits = packed.groupBy("bucket").applyInPandas(alone, "batch long, hits binary, head binary")
    found = hits.groupBy("batch").applyInPandas(total, "doc_id long, print long, n_alone long, n long")
    return found.groupBy("doc_id", "print").agg(F.max("n").alias("n"), F.sum("n_alone").alias("n_alone"))


def _value_batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        if batch.schema.names[-1] == "text":
            yield from text_batches(iter([batch]))
        else:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part, part.column("hashes").to_pylist()


def _sets(documents: DataFrame, width: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            sets = [shingle_set(t, width) for t in texts]
            data = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in data], pa.binary()),
                 pa.array(data, pa.binary())], ["doc_id", "print", "n", "digest", "hashes"])
    return documents.mapInArrow(build, "doc_id long, print long, n int, digest binary, hashes binary")


def _min_hashes(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """``id, band, key``: keys that similar sets are likely to share; they only choose pivots."""
    factors = np.random.default_rng(7).integers(0, 2**64, bands * rows, dtype=np.uint64) | np.uint64(1)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, data in zip(frame["id"], frame["hashes"], strict=True):
                s = np.frombuffer(data, np.uint64)
                low = [int((s * f).min()) for f in factors]
                for b in range(bands):
                    key = hash(tuple(low[b * rows:(b + 1) * rows])) & (2**63 - 1)
                    out.append((i, b, key))
            yield pd.DataFrame(out, columns=["id", "band", "key"])
    return sets.select("id", "hashes").mapInPandas(work, "id long, band int, key long")


def _rare_prefixes(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """``id, h, rest``: the hashes of each set's prefix, rarest first, that some other set may have too.

    ``rest`` counts the hash itself and all that come after it in the set.

    Any order that is the same for all sets gives right prefixes; this one is by
    how many sets hold a hash (in steps of an eighth of a power of two), so a
    passage that many sets share comes last. Sets travel in batches. A batch
    names each of its hashes once per bucket of hashes, with its own count, and
    gets one byte back for it: 0 if no other set has it.
    """
    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = TaskContext.get().partitionId() << 32
        for frame in frames:
            ends = frame["n"].to_numpy(np.int64).cumsum() // _BATCH_HASHES
            for _, part in frame.groupby(np.maximum(ends, np.arange(len(frame)) // 1000 + ends)):
                yield pd.DataFrame({
                    "batch": [turn], "ids": [part["id"].to_numpy(np.int64).tobytes()],
                    "sizes": [part["n"].to_numpy(np.int64).tobytes()], "hashes": [b"".join(part["hashes"])]})
                turn += 1

    def kinds_of(hashes: bytes):
        """The distinct hashes of a batch, each hash's place among them, their buckets, and their order by bucket."""
        kinds, at, count = np.unique(np.frombuffer(hashes, np.uint64), return_inverse=True, return_counts=True)
        bucket = ((kinds >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        return kinds, at, count, bucket, np.argsort(bucket, kind="stable")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch, hashes in zip(frame["batch"], frame["hashes"], strict=True):
                kinds, _, count, bucket, order = kinds_of(hashes)
                low, count = kinds.astype(np.uint32)[order], count.astype(np.uint32)[order]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                yield pd.DataFrame(
                    [(b, batch, low[x:y].tobytes(), count[x:y].tobytes())
                     for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x],
                    columns=["bucket", "batch", "hashes", "counts"])

    def level(frame: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["hashes"]])
        count = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["counts"]])
        _, at = np.unique(low, return_inverse=True)
        steps = np.minimum(255, np.rint(8 * np.log2(np.bincount(at, count)))).astype(np.uint8)[at]
        ends = np.cumsum([len(x) // 4 for x in frame["hashes"]])
        return pd.DataFrame({"bucket": frame["bucket"], "batch": frame["batch"],
                             "levels": [steps[x:y].tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)]})

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids, sizes = np.frombuffer(row.ids, np.int64), np.frombuffer(row.sizes, np.int64)
                kinds, at, _, _, order = kinds_of(row.hashes)
                steps = np.empty(len(kinds), np.uint8)
                steps[order] = np.frombuffer(
                    b"".join(x["levels"] for x in sorted(row.answers, key=lambda x: x["bucket"])), np.uint8)
                steps, hashes = steps[at], np.frombuffer(row.hashes, np.int64)
                owner = np.repeat(np.arange(len(ids)), sizes)
                order = np.lexsort((hashes, steps, owner))
                rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = (rank < (sizes - -(-sizes * percent // 100) + 1)[owner]) & (steps[order] > 0)
                yield pd.DataFrame({"id": ids[owner[first]], "h": hashes[order[first]],
                                    "rest": (sizes[owner] - rank)[first]})

    batches = stored(sets.select("id", "n", "hashes").mapInPandas(
        gather, "batch long, ids binary, sizes binary, hashes binary"), "batches")
    answers = batches.select("batch", "hashes").mapInPandas(
        spread, "bucket int, batch long, hashes binary, counts binary").groupBy("bucket").applyInPandas(
        level, "bucket int, batch long, levels binary").groupBy("batch").agg(
        F.collect_list(F.struct("bucket", "levels")).alias("answers"))
    return batches.join(answers, "batch").mapInPandas(prefixes, "id long, h long, rest long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return np.count_nonzero(x[at] == y)


def _distances(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Exact Jaccard distances of distinct pairs ``a, b`` (other columns are kept): ``d``, and ``linked`` on whole numbers."""
    extra = [f for f in pairs.schema.fields if f.name not in ("a", "b")]
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            same = np.empty(len(frame), np.int64)
            union = np.empty(len(frame), np.int64)
            for i, (x, y) in enumerate(zip(frame.pop("ha"), frame.pop("hb"), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same[i] = _common(x, y)
                union[i] = len(x) + len(y) - same[i]
            yield frame.assign(same=same, all=union)

    names = ["a", "b", *[f.name for f in extra]]
    schema = ", ".join(["a long, b long", *[f"{f.name} {f.dataType.simpleString()}" for f in extra], "same long, all long"])
    return stored(both.select(*names, "ha", "hb").mapInPandas(work, schema).withColumn(
        "d", 1 - F.col("same") / F.col("all")), label)


def _point_distances(tested: DataFrame, sides: DataFrame, regions: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Exact distances ``d`` of points ``a`` of a region ``home`` to the pivots ``b`` of others, as ``_distances`` gives them.

    A region of very many points may meet very many pivots. Its points and its
    pivots are dealt into blocks, and a set moves once for each block of the
    other kind, not once for each pair.
    """
    points = regions.groupBy("region").agg(F.ceil(F.count("*") / _BLOCK_POINTS).alias("of_points"))
    blocks = sides.groupBy("home").agg(F.ceil(F.count("*") / _BLOCK_PIVOTS).alias("of_pivots")).join(
        points.withColumnRenamed("region", "home"), "home")
    keys = ["home", "block_a", "block_b"]
    block_a, block_b = (F.pmod(F.xxhash64(c), F.col(n)).alias(f"block_{c}") for c, n in (("a", "of_points"), ("b", "of_pivots")))
    kept = [c for c in tested.columns if c != "b"]
    asked = tested.join(blocks, "home").select(*kept, "b", block_a, block_b).groupBy(
        *kept, "block_a", "block_b").agg(F.collect_list("b").alias("bs"))
    left = asked.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    right = sides.select("home", F.col("other").alias("b"), F.col("q.radius").alias("r_other")).join(blocks, "home").join(
        sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b").select(
        "home", "b", "r_other", "hb", block_b, F.explode(F.sequence(F.lit(0).cast("long"), F.col("of_points") - 1)).alias("block_a"))

    def work(points: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        known = {b: (np.frombuffer(h, np.uint64), r) for b, h, r in zip(pivots["b"], pivots["hb"], pivots["r_other"], strict=True)}
        out = []
        for bs, h in zip(points["bs"], points["ha"], strict=True):
            x = np.frombuffer(h, np.uint64)
            for b in bs:
                y, r_other = known[b]
                same = _common(x, y)
                out.append((b, r_other, same, len(x) + len(y) - same))
        rows = points[kept].loc[points.index.repeat(points["bs"].map(len).astype(int))].reset_index(drop=True)
        return rows.join(pd.DataFrame(out, columns=["b", "r_other", "same", "all"], index=rows.index))[names]

    names = [*kept, "b", "r_other", "same", "all"]
    kinds = dict(tested.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in kept], "b long, r_other double, same long, all long"])
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, schema)
    return stored(found.withColumn("d", 1 - F.col("same") / F.col("all")), label)


def jaccard_components(
    documents: DataFrame, percent: int = 75, width: int = 5, bands: int = 6, rows: int = 2,
) -> DataFrame:
    """``doc_id, print, n_shingles, component_id`` of every document with an id; ``print`` is the hash of its text.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their
    distinct ``width``-word shingles, that is within Jaccard distance
    r = 1 - percent / 100, which is a metric. Nothing is missed:

    1. A document with more than ``(100 - percent)`` percent shingles that no
       other document has cannot link and is done (``_census``).
    2. Equal sets become one point, and points are counted out once more.
    3. Pivots create regions: of the points that share a min-hash key the one
       with the smallest share of shingles of its own is their pivot; exact
       distances decide, and a point within r of several joins the nearest. A
       point within r of none is its own pivot. Points of a region are linked
       through their pivot, so no pair inside a region is ever compared.
    4. Linked points share one of the first ``n - ceil(n * percent / 100) + 1``
       hashes of either, in an order from rare to frequent hashes
       (``_rare_prefixes``). Regions of different components that meet under
       such a hash, and whose counts of common and own shingles and of shingles
       left from there on allow a link,
       are compared by their pivots; d(p, q) > R_p + r + R_q rules the whole
       pair of regions out.
    5. Otherwise windows replicate boundary points: x of p goes to q only if
       d(p, q) - d(x, p) <= R_q + r and |p & q| leaves room for that, and stays
       only if the exact d(x, q) <= R_q + r.
    6. The boundary points of both sides join again, sorted out by
       |d(x, p) - d(y, p)| <= r and |d(x, q) - d(y, q)| <= r before any set is
       read, and exactly after.

    Texts without words have no shingles, link with nothing and keep their own
    id. Rows without doc_id are left out. Rows that repeat a doc_id are compared
    by their own texts and share the id.
    """
    spark = documents.sparkSession
    r = 1 - percent / 100
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long"), fingerprint(F.col("text")).alias("print"), "text")
    census = stored(_census(texts, width, buckets), "census")
    able = census.where((F.col("n") > 0) & (100 * (F.col("n") - F.col("n_alone")) >= percent * F.col("n")))
    points = stored(_sets(texts.join(able.select("doc_id", "print"), ["doc_id", "print"], "left_semi"), width), "sets")
    classes = points.groupBy("digest").agg(F.min("doc_id").alias("id"))
    members = stored(points.select("doc_id", "print", "digest").join(classes, "digest"), "members")
    first = points.join(classes, "digest").where("doc_id = id").select(
        "id", "n", "digest", "hashes").dropDuplicates(["digest"])
    # rows that repeat a doc_id may lead several classes: all but one get the id of a point, not of a document
    numbered = first.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("digest")))
    numbered = stored(numbered.withColumn("point", F.when(F.col("k") == 1, F.col("id")).otherwise(
        F.xxhash64("digest"))), "points")
    again = _census(numbered.select(F.col("point").alias("doc_id"), F.lit(0).cast("long").alias("print"), "hashes"), width, buckets)
    alone = again.select(F.col("doc_id").alias("id"), "n_alone")
    sets = stored(numbered.select(F.col("point").alias("id"), "n", "hashes").join(alone, "id").where(
        100 * (F.col("n") - F.col("n_alone")) >= percent * F.col("n")), "candidates")
    twins = numbered.where("k > 1").select(F.col("id").alias("a"), F.col("point").alias("b"))

    # 3. regions
    keyed = stored(_min_hashes(sets, bands, rows).join(sets.select("id", (F.col("n_alone") / F.col("n")).alias("odd")), "id"), "keys")
    leaders = keyed.groupBy("band", "key").agg(F.min_by("id", F.struct("odd", "id")).alias("b"))
    proposed = keyed.join(leaders, ["band", "key"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    reach = _distances(proposed, sets, "reach").where(100 * F.col("same") >= percent * F.col("all"))
    nearest = reach.groupBy("a").agg(F.min_by(F.struct("b", "d", "same"), F.struct("d", "b")).alias("p"))
    regions = stored(sets.select("id", "n", F.col("n_alone").alias("own"), (F.col("n") - F.col("n_alone")).alias("common")).join(
        nearest, F.col("id") == F.col("a"), "left").select(
        "id", "own", "common", F.coalesce("p.b", "id").alias("region"), F.coalesce("p.d", F.lit(0.0)).alias("d"),
        F.coalesce("p.same", F.col("n").cast("long")).alias("with_home")), "regions")
    ranges = [F.min("own").alias("own"), F.min("common").alias("low"), F.max("common").alias("high")]
    radius = regions.groupBy("region").agg(F.max("d").alias("radius"), *ranges)

    def may_link(x: str, y: str):
        """Whether the common and own shingles allow a link: |A & B| <= least common part, |A | B| >= both own parts and the largest common part."""
        return 100 * F.least(f"{x}.high", f"{y}.high") >= percent * (
            F.col(f"{x}.own") + F.col(f"{y}.own") + F.greatest(f"{x}.low", f"{y}.low"))
    parts = connected_components(reach.select("a", "b"), "reach")
    links = [parts.where("id <> component").toDF("a", "b"), twins]
    labelled = regions.join(parts.withColumnRenamed("id", "region"), "region", "left").select(
        "id", "own", "common", "region", F.coalesce("component", "region").alias("component"))

    # 4. regions of different components under a common hash, rare hashes first
    under = _rare_prefixes(sets, percent, buckets).join(labelled, "id")
    under = stored(under.groupBy("h", "region", "component").agg(
        *ranges, F.max("rest").alias("rest"), F.min(F.col("own") + F.col("common")).alias("n")), "under")
    mixed = under.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    meet = under.join(mixed.select("h"), "h", "left_semi")
    p, q = meet.alias("p"), meet.alias("q")
    # if h is the first hash two points share, |A & B| <= the smaller rest; a linked pair passes at its first
    first_meeting = (100 + percent) * F.least("p.rest", "q.rest") >= percent * (F.col("p.n") + F.col("q.n"))
    near = p.join(q, (F.col("p.h") == F.col("q.h")) & (F.col("p.region") < F.col("q.region"))
                  & (F.col("p.component") != F.col("q.component"))
                  & may_link("p", "q") & first_meeting).select(F.col("p.region").alias("a"), F.col("q.region").alias("b")).distinct()
    between = _distances(near, sets, "pivots")
    links.append(between.where(100 * F.col("same") >= percent * F.col("all")).select("a", "b"))
    close = between.join(radius.select(F.col("region").alias("a"), F.col("radius").alias("ra")), "a").join(
        radius.select(F.col("region").alias("b"), F.col("radius").alias("rb")), "b").where(
        F.col("d") <= F.col("ra") + F.col("rb") + r + _SLACK).select("a", "b", F.col("d").alias("d_pq"), F.col("same").alias("with_other"), "ra", "rb")
    close = stored(close.where("ra > 0 or rb > 0"), "close")

    # 5. boundary points; the sides are named four times below
    sides = stored(close.select(F.col("a").alias("home"), F.col("b").alias("other"), "d_pq", "with_other").unionByName(
        close.select(F.col("b").alias("home"), F.col("a").alias("other"), "d_pq", "with_other")).join(
        sets.select(F.col("id").alias("other"), F.col("n").alias("n_q"), (F.col("n") - F.col("n_alone")).alias("c_q")), "other").join(
        radius.select(F.col("region").alias("other"), F.struct("own", "low", "high", "radius").alias("q")), "other"), "sides")
    inner = regions.select("id", F.col("region").alias("home"), F.col("d").alias("d_home"), "with_home", F.struct(
        "own", F.col("common").alias("low"), F.col("common").alias("high")).alias("x"))
    # |x & q| is at most |p & q| and what x and q can share besides p
    most = F.col("with_other") + F.least(F.col("x.low") - F.col("with_home"), F.col("c_q") - F.col("with_other"))
    least_d = 1 - most / (F.col("x.own") + F.col("x.low") + F.col("n_q") - most)
    tested = inner.join(sides, "home").where(
        (F.greatest(F.col("d_pq") - F.col("d_home"), least_d) <= F.col("q.radius") + r + _SLACK) & may_link("x", "q"))
    moved = _point_distances(tested.select(
        F.col("id").alias("a"), F.col("other").alias("b"), "home", "d_home",
        F.col("x.own").alias("own"), F.col("x.low").alias("common")), sides, regions, sets, "moved")
    links.append(moved.where(100 * F.col("same") >= percent * F.col("all")).select("a", "b"))
    edge = moved.where(F.col("d") <= F.col("r_other") + r + _SLACK).select(
        F.col("a").alias("id"), "home", F.col("b").alias("other"), "d_home", F.col("d").alias("d_other"), "own",
        F.col("common").alias("low"), F.col("common").alias("high"))

    # 6. both sides again
    x, y = edge.alias("x"), edge.alias("y")
    final = x.join(y, (F.col("x.home") == F.col("y.other")) & (F.col("x.other") == F.col("y.home"))
                   & (F.col("x.home") < F.col("y.home")) & may_link("x", "y")
                   & (F.abs(F.col("x.d_home") - F.col("y.d_other")) <= r + _SLACK)
                   & (F.abs(F.col("x.d_other") - F.col("y.d_home")) <= r + _SLACK)).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    links.append(_distances(final, sets, "edges").where(100 * F.col("same") >= percent * F.col("all")).select("a", "b"))

    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    found = connected_components(stored(every, "every"), "links")
    # the smallest document id of a component; ids of points that are no documents do not count
    labels = numbered.select("digest", "id", F.col("point")).join(
        found.select(F.col("id").alias("point"), "component"), "point", "left").select(
        "digest", "id", F.coalesce("component", "point").alias("component"))
    least = labels.groupBy("component").agg(F.min("id").alias("component_id"))
    settled = members.join(labels.select("digest", "component"), "digest").join(least, "component").select(
        "doc_id", "print", "component_id").distinct()
    return census.join(settled, ["doc_id", "print"], "left").select(
        "doc_id", "print", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(documents: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, n_shingles, component_id``.

    Rows that repeat a doc_id all get the smallest id any of them reaches. A
    row without doc_id has no component and 0 shingles. An empty table gives no
    rows.
    """
    found = jaccard_components(documents, percent, width)
    rows = documents.select("doc_id", fingerprint(F.col("text")).alias("print"))
    return rows.join(found, ["doc_id", "print"], "left").select(
        "doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "component_id")


def one_of_each_group(documents: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``documents`` with only the row of the smallest doc_id of each linked group; equal rows stay once.

    Rows without doc_id link with nothing and all stay.
    """
    found = jaccard_components(documents, percent, width)
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("print").alias("__print"))
    named = documents.where(F.col("doc_id").isNotNull()).withColumn("__print", fingerprint(F.col("text")))
    kept = named.join(first, ["doc_id", "__print"], "left_semi").dropDuplicates(["doc_id", "__print"])
    return kept.select(*documents.columns).unionByName(documents.where(F.col("doc_id").isNull()))
