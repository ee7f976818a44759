"""Old labels against new ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.functions.text import truncate

TITLE_CHARS = 60
REASONING_CHARS = 100


def sample_head(df: DataFrame, n: int | None, by: str = "id") -> DataFrame:
    """The first n rows by `by`, or all of them for None."""
    return df if n is None else df.orderBy(by).limit(n)


def compare_join(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, category) joined with new results on id."""
    return old.select("id", F.col("category").alias("old_label")).join(
        new.withColumnRenamed("category_label", "new_label"), "id"
    )


def with_changed(compared: DataFrame) -> DataFrame:
    return compared.withColumn("changed", ~F.col("old_label").eqNullSafe(F.col("new_label")))


def changed_only(compared: DataFrame) -> DataFrame:
    """Papers whose label changed, in the short form a report prints."""
    return (
        with_changed(compared)
        .filter("changed")
        .select(
            "id",
            truncate(F.col("title"), TITLE_CHARS, "...").alias("title"),
            "old_label",
            "new_label",
            "confidence",
            "method",
            truncate(F.col("reasoning"), REASONING_CHARS, "...").alias("reasoning"),
        )
    )


def reclass_stats(compared: DataFrame) -> DataFrame:
    """total, by_llm, by_rule, changed and changed_pct, in one pass."""
    by_llm = F.count_if(F.col("method") == "llm")
    changed = F.count_if("changed")
    return with_changed(compared).agg(
        F.count("*").alias("total"),
        by_llm.alias("by_llm"),
        (F.count("*") - by_llm).alias("by_rule"),
        changed.alias("changed"),
        F.format_number(100.0 * changed / F.nullif(F.count("*"), F.lit(0)), 1).alias("changed_pct"),
    )


def label_transitions(compared: DataFrame) -> DataFrame:
    return compared.groupBy("old_label", "new_label").agg(F.count("*").alias("n"))
