"""What one analysis looks for: a topic and a taxonomy."""

from dataclasses import dataclass

from pyspark.sql import Row, SparkSession

from topicflow.functions import fixed
from topicflow.operators import resume, taxonomy, topic


@dataclass(frozen=True)
class Setup:
    topic: str | None
    topic_patterns: list[str]
    rows: list[Row]
    default_label: str
    long_tail_label: str

    def fingerprint(self, threshold: float | None = None, scorer: str = "", classifier: str = "") -> str:
        """Names the results that this setup gives with a threshold, a scorer and a classifier of the user's own."""
        return resume.fingerprint(self.rows, self.topic, self.default_label, threshold, scorer, classifier)


def builtin_setup() -> Setup:
    """The default topic with the built-in taxonomy."""
    return Setup(
        topic=None,
        topic_patterns=list(fixed.DEFAULT_TOPIC_PATTERNS),
        rows=taxonomy.builtin_rows(),
        default_label=fixed.BUILTIN_DEFAULT_LABEL,
        long_tail_label=fixed.BUILTIN_LONG_TAIL_LABEL,
    )


def custom_setup(spark: SparkSession, topic_text: str, categories: str) -> Setup:
    """A topic and categories as the user wrote them; ValueError if they are wrong."""
    return Setup(
        topic=topic_text,
        rows=taxonomy.custom_rows(spark, topic_text, categories),
        topic_patterns=topic.topic_patterns(spark, topic_text),
        default_label=fixed.CUSTOM_DEFAULT_LABEL,
        long_tail_label=fixed.LONG_TAIL_LABEL,
    )


def choose_setup(spark: SparkSession, topic_text: str | None = None, categories: str | None = None) -> Setup:
    """The built-in setup unless a topic or categories are given."""
    if not topic_text and not categories:
        return builtin_setup()
    return custom_setup(spark, topic_text or "", categories or "")
