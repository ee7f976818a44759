"""Counts, shares and trends.

Everything starts from one pre-aggregated groupBy on a category, so a category
holding most of the rows still reaches the shuffle as one row per task.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicflow.functions import fixed
from topicflow.functions.text import display_label, pct_label


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose grouping keys are all present.

    Plain null tests: where a key cannot be null, such as a computed category,
    Catalyst removes the test instead of computing the key a second time for it.
    """
    return reduce(lambda rows, key: rows.filter(F.col(key).isNotNull()), keys, df)


def category_counts(df: DataFrame, column: str = "category") -> DataFrame:
    """Rows per category, largest first, equal counts by label."""
    return (
        drop_null_keys(df, column).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    )


def method_counts(classified: DataFrame) -> DataFrame:
    return category_counts(classified, "method")


def matched_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("conf", "year").agg(F.count("*").alias("matched"))


def category_share(df: DataFrame) -> DataFrame:
    """Counts with their share of all rows and the labels a chart shows."""
    counts = drop_null_keys(df, "category").groupBy("category").agg(F.count("*").alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return (
        counts.withColumn("pct", 100.0 * F.col("n") / total)
        .withColumn("display", display_label(F.col("category")))
        .withColumn("pct_label", pct_label(F.col("pct")))
        .select("category", "display", "n", "pct", "pct_label")
    )


def year_category_counts(df: DataFrame) -> DataFrame:
    """(year, category, count), the long form."""
    return drop_null_keys(df, "year", "category").groupBy("year", "category").agg(F.count("*").alias("count"))


def year_category_pivot(df: DataFrame, categories: list[str]) -> DataFrame:
    """One row per year in ascending order, one column per category, missing = 0.

    The categories come from the taxonomy, so no extra job looks for them.
    """
    return (
        drop_null_keys(df, "year", "category")
        .groupBy("year")
        .pivot("category", categories)
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .orderBy("year")
    )


def counts_by_requested_year(df: DataFrame, years: list[int]) -> DataFrame:
    """category, by_year (one count per requested year, in order), total.

    Other years are not counted; a category that only occurs there keeps its row,
    all zero.
    """
    per_year = [F.count_if(F.col("year") == int(y)) for y in years]
    return (
        drop_null_keys(df, "year", "category")
        .groupBy("category")
        .agg(F.array(*per_year).alias("by_year"))
        .withColumn("total", F.aggregate("by_year", F.lit(0).cast("bigint"), lambda a, b: a + b))
    )


def year_spine(df: DataFrame, years: list[int]) -> DataFrame:
    """(year, position, category, count) for every requested year and category, zeros included."""
    requested = F.array(*[F.lit(int(y)) for y in years])
    return counts_by_requested_year(df, years).select(
        "category", F.posexplode(F.arrays_zip(requested.alias("year"), "by_year")).alias("position", "cell")
    ).select(F.col("cell.year").alias("year"), "position", "category", F.col("cell.by_year").alias("count"))


def category_totals(df: DataFrame, years: list[int]) -> DataFrame:
    return counts_by_requested_year(df, years).select("category", "total").orderBy(F.desc("total"), "category")


def year_totals(df: DataFrame, years: list[int]) -> DataFrame:
    """Rows of all categories per requested year."""
    return year_spine(df, years).groupBy("year").agg(F.sum("count").alias("year_total"))


def topk_categories(df: DataFrame, years: list[int], k: int = fixed.DEFAULT_TOPK) -> DataFrame:
    """The k categories with the largest totals, equal totals by label."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return category_totals(df, years).limit(k)


def topk_trend(
    df: DataFrame, years: list[int], k: int = fixed.DEFAULT_TOPK, other_label: str = fixed.LONG_TAIL_LABEL
) -> DataFrame:
    """(year, category, count, year_total, is_other): the k largest categories, the rest as one series.

    One shuffle of the input, on category.  What follows works on one row per
    category: the top k are found without sorting all categories in one task,
    and marked by a broadcast of k rows.
    """
    totals = counts_by_requested_year(df, years)
    kept = F.broadcast(topk_categories(df, years, k).select("category", F.lit(False).alias("is_other")))
    requested = F.array(*[F.lit(int(y)) for y in years])
    series = (
        totals.join(kept, "category", "left")
        .withColumn("is_other", F.coalesce("is_other", F.lit(True)))
        .withColumn("category", F.when(F.col("is_other"), F.lit(other_label)).otherwise(F.col("category")))
        .select(
            "category", "is_other", F.explode(F.arrays_zip(requested.alias("year"), "by_year")).alias("cell")
        )
        .groupBy(F.col("cell.year").alias("year"), "category", "is_other")
        .agg(F.sum("cell.by_year").alias("count"))
    )
    year_total = F.sum("count").over(Window.partitionBy("year"))
    return series.select("year", "category", "count", year_total.alias("year_total"), "is_other")


def restrict_years(df: DataFrame, years: list[int]) -> DataFrame:
    """Rows of the requested years; the list reaches the scan as a pushed filter."""
    return df.filter(F.col("year").isin([int(y) for y in years]))


def sort_years(df: DataFrame) -> DataFrame:
    return df.orderBy("year")


def year_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; repeats stay."""
    return reduce(DataFrame.unionByName, sources)
