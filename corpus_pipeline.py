"""From raw documents to packed sequences: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.llm import hyperminhash, language_id, line_dedup, packing, raking
from topicflow.session import materialize

LEAST_SCORE = 0.3
"""Pooled probability below which no language is taken as recognised."""


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among `gone`; rows without doc_id stay."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that was learned, go; `lang` stays what it was."""
    found = language_id.identify(docs)
    return _without(docs, found.filter((F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LEAST_SCORE)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-duplicate lines stays; a document that had lines and lost all of them goes.

    `n_chars` is counted anew.  Rows that share a doc_id must share their text, as one decision holds for both.
    """
    found = line_dedup.left_lines(docs, line_dedup.kept_lines(docs))
    row, text = F.col("row"), F.array_join("left", "\n")
    lost = F.exists("lines", line_dedup.not_blank) & ~F.exists("left", line_dedup.not_blank)
    new = {"text": F.when(row["text"].isNotNull(), text), "n_chars": F.when(row["text"].isNotNull(), F.length(text).cast("long"))}
    known = found.filter(~lost).select([new.get(c, row[c]).alias(c) for c in docs.columns])
    return known.unionByName(docs.filter("doc_id IS NULL"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five words, similarity 0.8) stays."""
    return _without(docs, hyperminhash.near_duplicates(docs, size=5, percent=80).filter("NOT kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half of the tokens, raked to flattened shares of sources and languages."""
    return _without(docs, raking.sample(docs).filter("NOT sampled"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
