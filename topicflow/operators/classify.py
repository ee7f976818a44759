"""Rule classification: the first category, by priority, with a matching pattern."""

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from topicflow.functions import fixed
from topicflow.functions.regex import FLAGS, matches_any
from topicflow.functions.text import match_text
from topicflow.operators.joins import join_bounded


def rule_priority(text: Column, rows: list[Row]) -> Column:
    """Priority of the winning category, null when none matches.

    One search for any pattern at all settles the texts that match nothing; the
    others go through a CASE, evaluated lazily in priority order, with one
    pattern per category.
    """
    ordered = sorted(rows, key=lambda r: r.priority)
    case = F
    for row in ordered:
        case = case.when(matches_any(text, row.patterns), row.priority)
    return F.when(matches_any(text, [p for r in ordered for p in r.patterns]), case)


def category_key(priority: Column, rows: list[Row]) -> Column:
    return _by_priority(priority, rows, "key", fixed.DEFAULT_KEY)


def category_label(priority: Column, rows: list[Row], default_label: str) -> Column:
    return _by_priority(priority, rows, "label", default_label)


def _by_priority(priority: Column, rows: list[Row], field: str, default: str) -> Column:
    names = F.create_map(*[F.lit(v) for r in rows for v in (r.priority, r[field])])
    return F.coalesce(F.try_element_at(names, priority), F.lit(default))


def classify_rules(papers: DataFrame, rows: list[Row], default_label: str) -> DataFrame:
    """Adds category_key and category_label; all other columns are carried along."""
    text = match_text(F.col("title"), F.col("abstract"))
    number = F.col("_priority")
    return (
        papers.withColumn("_priority", rule_priority(text, rows))
        .withColumn("category_key", category_key(number, rows))
        .withColumn("category_label", category_label(number, rows, default_label))
        .drop("_priority")
    )


def match_evidence(papers: DataFrame, rows: list[Row]) -> DataFrame:
    """Every (category, pattern) found in a paper, with the text it found.

    Only hits leave the row, so a paper's text is not copied once per pattern,
    and a category's patterns are tried one by one only where one of them matches.
    """
    text = match_text(F.col("title"), F.col("abstract"))
    hits = []
    for row in rows:
        tried = F.array(
            *[
                F.struct(
                    F.lit(row.priority).alias("priority"),
                    F.lit(row.key).alias("category_key"),
                    F.lit(number).alias("pattern_no"),
                    F.lit(pattern).alias("pattern"),
                    F.when(matches_any(text, [pattern]), F.regexp_extract(text, FLAGS + pattern, 0)).alias("found"),
                )
                for number, pattern in enumerate(row.patterns, 1)
            ]
        )
        hits.append(F.when(matches_any(text, row.patterns), F.filter(tried, lambda t: t.found.isNotNull())))
    listed = F.flatten(F.array_compact(F.array(*hits)))
    return papers.select("id", F.explode(listed).alias("hit")).select("id", "hit.*")


def lookup_category(keys: DataFrame, taxonomy: DataFrame, default_label: str) -> DataFrame:
    """Adds category_label for a category_key; an unknown key gets the default label."""
    names = taxonomy.select(F.col("key").alias("category_key"), F.col("label").alias("category_label"))
    return join_bounded(keys, names, "category_key", "left").withColumn(
        "category_label", F.coalesce("category_label", F.lit(default_label))
    )
