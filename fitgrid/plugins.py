"""Extension points: scorers that write the probability tables the judgement rules read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrid.session import checkpointed

Scorer = Callable[[pd.DataFrame], pd.DataFrame]
SCORES = "document_id bigint, axis_key string, position int, choice string, weight double"

# Words of the bundled scorer per axis and anchor.
KEYWORDS = {
    "work_location": {"100": ("フルリモート", "在宅"), "50": ("週2日", "週3日"), "0": ("原則出社",)},
    "schedule_flexibility": {"100": ("コアタイムなし",), "50": ("フレックスタイム",), "0": ("固定勤務",)},
    "autonomy": {"100": ("裁量", "設計"), "0": ("指示",)},
    "role_breadth": {"100": ("幅広い",), "50": ("開発",)},
}


def keyword_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic scorer: one point for each keyword a fragment contains."""
    parts = []
    for axis, anchors in KEYWORDS.items():
        for choice, words in anchors.items():
            hits = sum(batch["text"].str.contains(w, regex=False).astype(float) for w in words)
            found = batch.loc[hits > 0, ["document_id", "position"]].assign(
                axis_key=axis, choice=choice, weight=hits[hits > 0])
            parts.append(found)
    columns = ["document_id", "axis_key", "position", "choice", "weight"]
    return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)


def score_axes(fragments: DataFrame, scorer: Scorer = keyword_scorer) -> tuple[DataFrame, DataFrame]:
    """(choices, evidence) tables from a scorer that sees batches of fragments.

    The scorer rates fragments one batch at a time; shares per document are
    formed by Spark, so a scorer never needs a whole document or corpus.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)
    # Scoring is the costly part and its result is read three times, so it is kept.
    scored = checkpointed(fragments.select("document_id", "position", "text").mapInPandas(run, SCORES))
    per_choice = scored.groupBy("document_id", "axis_key", "choice").agg(F.sum("weight").alias("w"))
    totals = per_choice.groupBy("document_id", "axis_key").agg(F.sum("w").alias("total"))
    choices = per_choice.join(totals, ["document_id", "axis_key"]).select(
        "document_id", "axis_key", "choice", (F.col("w") / F.col("total")).alias("probability"),
        (F.col("w") / F.col("total")).alias("confidence"))
    per_fragment = scored.groupBy("document_id", "axis_key", "position").agg(F.sum("weight").alias("w"))
    evidence = (
        per_fragment.join(totals, ["document_id", "axis_key"])
        .join(fragments.select("document_id", "position", "text"), ["document_id", "position"])
        .select("document_id", "axis_key", "position", (F.col("w") / F.col("total")).alias("probability"), "text")
    )
    return choices, evidence
