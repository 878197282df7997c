"""A corpus pipeline of five stages over ``documents``; each stage is one operator, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrid.llm import jaccard, line_dedup, mixing, packing, toxicity
from fitgrid.llm.common import stored, table
from fitgrid.llm.tokens import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, trained on the labels, does not reject."""
    tagger = toxicity.tagger_for(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, tagger, keep=docs.columns, prefix="__")
    return scored.where("__predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the lines it keeps; its length is counted anew."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    return jaccard.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mixing.mix_sources(docs, keep=docs.columns, prefix="__")
    return mixed.where("__times > 0").withColumn(
        "__times", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("jaccard join", drop_near_duplicates),
    ("mixing", mix), ("packing", pack),
]

# A trained tagger, a hash order and a tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
