"""Spelling variants: words one edit apart, found by asymmetric chunks and positional grams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrid.llm.common import ascii_lower, stored, whole

LETTER = "[A-Za-zÀ-ÿ]"


def words(documents: DataFrame, noise: int = 199, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """``word, n``: lower-cased runs of letters of at least ``min_chars`` code points that occur ``min_count`` times.

    Where ``noise`` divides the crc32 of ``doc_id:run``, the run loses the code
    point at crc32 modulo its length. Null texts have no runs, a null doc_id is
    written as nothing.
    """
    long_runs = F.lit(f"{LETTER}{{{min_chars},}}")  # a shorter run is no word, whatever happens to it
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(ascii_lower(whole()), long_runs, F.lit(0))).alias("run"))
    marked = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    return marked.select(word.alias("word")).where(F.char_length("word") >= min_chars).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= min_count)


def _kept(length: Column, levels: int) -> list[tuple[Column, Column]]:
    """What one edit can leave of a word: (characters at the front, at the back) for each choice of chunks.

    A word with a front and a back that are whole cuts what lies open between
    them into two chunks of half its length, one at either end. One edit spoils
    one of them at most; the other joins its end, and the rest lies open.
    """
    found = [(F.lit(0), F.lit(0))]
    for _ in range(levels):
        found = [
            pair for front, back in found for half in [F.floor((length - front - back) / 2).cast("int")]
            for pair in ((front + half, back), (front, back + half))]
    return found


def _grams(word: Column, length: Column, levels: int) -> list[Column]:
    """The word's characters at those places, as one key each."""
    return [F.concat(F.left(word, front), F.lit(":"), F.right(word, back)) for front, back in _kept(length, levels)]


def near_words(vocabulary: DataFrame, levels: int = 2) -> DataFrame:
    """``word, other``: all pairs of different words that one inserted, deleted or replaced code point sets apart, once.

    Asymmetric chunks: ``word``, the longer of a pair or the first of equal
    length, contributes two disjoint chunks; ``other`` all its grams that can
    stand where a chunk does. A chunk that the edit leaves whole stays at its
    place from the front, or at its place from the back, which is a shift of the
    difference in length, one at most. Since many words share half of their
    characters, the open half is cut into two chunks again, ``levels`` times in
    all, so that a key holds three quarters of a word and rare keys are the
    rule. A pair counts for the first of its common keys; the edit distance
    is verified.
    """
    sized = vocabulary.select("word", F.char_length("word").alias("size"))
    chunks = sized.select("word", "size", F.posexplode(F.array(*_grams(F.col("word"), F.col("size"), levels))).alias("place", "key"))
    grams = sized.select(
        F.col("word").alias("other"), F.col("size").alias("own"),
        F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"),
    ).select("other", "own", "size", F.posexplode(F.array(*_grams(F.col("other"), F.col("size"), levels))).alias("place", "key"))
    first = F.lit(False)
    for i, (ours, theirs) in reversed(list(enumerate(zip(
            _grams(F.col("word"), F.col("size"), levels), _grams(F.col("other"), F.col("size"), levels), strict=True)))):
        first = F.when(ours == theirs, F.col("place") == i).otherwise(first)
    return chunks.join(grams, ["size", "place", "key"]).where(
        ((F.col("own") < F.col("size")) | (F.col("word") < F.col("other")))
        & (F.levenshtein("word", "other", 1) == 1) & first).select("word", "other")


def group_variants(vocabulary: DataFrame, ratio: int = 5, levels: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``vocabulary`` (``word, n``; each word once).

    ``form`` is the near word of largest ``n``, of equal ones the first in
    code-point order, if its ``n`` is at least ``ratio`` times the word's;
    ``root`` is the last word that forms lead to, the word itself without one.
    Along forms ``n`` grows by ``ratio`` each time, so the largest ``n`` bounds
    the steps, and their square root's worth of rounds finds every root. An empty
    vocabulary gives no rows.
    """
    pairs = near_words(vocabulary, levels)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    best = both.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").groupBy(
        "word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("best"))
    near = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.col1") >= ratio * F.col("n"), F.struct(
            F.col("best.other").alias("form"), (-F.col("best.col1")).alias("form_n"))).alias("best"))
    found = stored(near.select("word", "n", "n_near", "best.form", "best.form_n"), "near-words")
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    largest = found.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(largest, ratio)) + 1
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), "roots")
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """Variant groups of the words of whole texts; see ``words`` and ``group_variants``."""
    return group_variants(stored(words(documents.select("doc_id", "text")), "words"))
