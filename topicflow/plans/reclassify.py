"""Stored labels -> new labels -> what changed."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from topicflow.functions import fixed
from topicflow.functions.text import paper_hash
from topicflow.operators import compare
from topicflow.operators.scoring import Scorer, TableScorer, hybrid_classify
from topicflow.plans.setup import Setup
from topicflow.plans.trend_report import score_papers
from topicflow.session import materialize
from topicflow.sources import tables


@dataclass(frozen=True)
class Reclassified:
    results: DataFrame
    compared: DataFrame
    stats: DataFrame
    transitions: DataFrame
    changed: DataFrame


def reclassify(
    stored: DataFrame,
    predictions: DataFrame | None,
    rows: list[Row],
    default_label: str,
    n: int | None = None,
    threshold: float = fixed.CONFIDENCE_THRESHOLD,
) -> Reclassified:
    """Classify a stored table (title, abstract, category) again; n limits it to the first rows.

    Without an id, as in the simple table, rows are named by conference, year and text; rows that repeat share the name,
    and as every row carries its old label none is joined or lost.

    The new results are written once and compared from there, so the reports do
    not classify again.
    """
    return _compared(hybrid_classify(_sample(stored, n), predictions, rows, default_label, threshold))


def reclassify_scored(
    stored: DataFrame,
    scorer: Scorer | TableScorer,
    setup: Setup,
    cache_path: str | None = None,
    n: int | None = None,
    threshold: float = fixed.CONFIDENCE_THRESHOLD,
    batch_size: int = fixed.RECLASSIFY_BATCH_SIZE,
) -> Reclassified:
    """As `reclassify`, with a scorer: the texts that the cache under `cache_path` does not know are scored first.

    Answers go to the cache, so that a second run asks for what is new only.
    """
    spark = stored.sparkSession
    sample = materialize(_sample(stored, n), "sample")
    cache = tables.read_stored_cache(spark, cache_path) if cache_path else spark.createDataFrame([], tables.CACHE)
    scored = score_papers(sample, cache, scorer, setup, batch_size)
    predictions = materialize(scored.predictions, "predictions")
    if cache_path:
        tables.update_stored_cache(scored.fresh, cache_path)
    return _compared(hybrid_classify(sample, predictions, setup.rows, setup.default_label, threshold))


def _sample(stored: DataFrame, n: int | None) -> DataFrame:
    if "id" not in stored.columns:
        known = [c for c in ("conf", "year") if c in stored.columns]
        stored = stored.withColumn("id", F.concat_ws("_", *known, paper_hash(F.col("title"), F.col("abstract"))))
    return compare.sample_head(stored, n).na.fill("", ["title", "abstract"]).withColumnRenamed("category", "old_label")


def _compared(results: DataFrame) -> Reclassified:
    results = materialize(results, "reclassified")
    compared = results.withColumnRenamed("category_label", "new_label")
    return Reclassified(
        results=results.drop("old_label"),
        compared=compared,
        stats=compare.reclass_stats(compared),
        transitions=compare.label_transitions(compared),
        changed=compare.changed_only(compared),
    )
