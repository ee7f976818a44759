"""Topic filters."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.functions.fixed import DEFAULT_TOPIC_PATTERNS
from topicflow.functions.keywords import keyword_variants, topic_words
from topicflow.functions.regex import matches_any, word_pattern
from topicflow.functions.text import match_text


def compile_topics(specs: DataFrame) -> DataFrame:
    """Adds topic_patterns, topic_regex and topic_description to rows with a `topic`.

    Any word of the topic, or a variant of one, puts a record on topic.  A topic
    made only of separators gives the empty pattern, which matches everything.
    """
    found = topic_words(F.col("topic"))
    forms = F.array_sort(F.array_distinct(F.flatten(F.transform(found, keyword_variants))))
    return (
        specs.withColumn("topic_patterns", F.transform(forms, word_pattern))
        .withColumn("topic_regex", F.array_join("topic_patterns", "|"))
        .withColumn(
            "topic_description",
            F.concat(
                F.lit("Topic: "), F.col("topic"), F.lit(" (keywords: "), F.array_join(found, ", "), F.lit(")")
            ),
        )
    )


def topic_patterns(spark: SparkSession, topic: str | None) -> list[str]:
    """Patterns of one topic; None is the default topic."""
    if topic is None:
        return list(DEFAULT_TOPIC_PATTERNS)
    row = compile_topics(spark.createDataFrame([(topic,)], "topic string")).first()
    return row["topic_patterns"]


def on_topic(text: Column, patterns: list[str]) -> Column:
    return matches_any(text, patterns) if patterns else F.lit(True)


def filter_topic(papers: DataFrame, topic: str | None = None) -> DataFrame:
    """Papers whose title and abstract are on topic (one narrow stage)."""
    patterns = topic_patterns(papers.sparkSession, topic)
    return papers.filter(on_topic(match_text(F.col("title"), F.col("abstract")), patterns))
