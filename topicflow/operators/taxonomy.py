"""Taxonomies: the built-in one, and ones compiled from user specifications.

A taxonomy is rows (taxonomy_id, priority, key, label, description, patterns).
User specifications are compiled inside their own row with array expressions, so
any number of them compiles in one narrow stage.
"""

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from topicflow.functions import fixed
from topicflow.functions.keywords import label_keywords, user_keywords
from topicflow.functions.regex import word_pattern
from topicflow.functions.text import is_blank, strip

BUILTIN_ID = "builtin"
SCHEMA = (
    "taxonomy_id string, priority int, key string, label string, description string, "
    "patterns array<string>"
)
KEYWORDS_IN_DESCRIPTION = 10


def builtin_rows() -> list[Row]:
    """The built-in taxonomy in priority order."""
    return [
        Row(priority=p, key=key, label=label, description=text, patterns=list(patterns))
        for p, key, label, text, patterns in sorted(fixed.BUILTIN_TAXONOMY)
    ]


def rows_table(spark: SparkSession, rows: list[Row], taxonomy_id: str) -> DataFrame:
    """Taxonomy rows held by the driver, as a table."""
    values = [(taxonomy_id, r.priority, r.key, r.label, r.description, r.patterns) for r in rows]
    return spark.createDataFrame(values, SCHEMA)


def builtin_table(spark: SparkSession) -> DataFrame:
    return rows_table(spark, builtin_rows(), BUILTIN_ID)


def parse_specs(specs: DataFrame) -> DataFrame:
    """(taxonomy_id, topic, spec) -> one row per category, or one row with an error.

    A spec is "label:keyword,keyword;label:keyword".  A repeated label keeps its
    first position and takes its last keywords.
    """
    parts = F.filter(F.transform(F.split("spec", ";"), strip), lambda p: p != "")

    def entry(part: Column) -> Column:
        label = strip(F.substring_index(part, ":", 1))
        rest = F.substring(part, F.instr(part, ":") + 1, F.length(part))
        keywords = F.array_sort(F.array_distinct(F.concat(user_keywords(rest), label_keywords(label))))
        problem = F.when(~F.contains(part, F.lit(":")), "missing colon").when(label == "", "empty label")
        return F.struct(label.alias("label"), keywords.alias("keywords"), problem.alias("problem"))

    given_topic = F.coalesce(F.col("topic"), F.lit("")) != ""
    given_spec = F.coalesce(F.col("spec"), F.lit("")) != ""
    problems = F.filter("entries", lambda e: e.problem.isNotNull())
    error = (
        F.when(given_topic != given_spec, "topic and categories must be given together")
        .when(~given_spec | is_blank(F.col("spec")), "empty categories")
        .when(F.size(problems) > 0, F.try_element_at(problems, F.lit(1)).problem)
        .when(F.size("entries") == 0, "no category")
    )
    labels = F.array_distinct(F.transform("entries", lambda e: e.label))
    categories = F.transform(
        labels,
        lambda label, i: F.struct(
            (i + 1).alias("priority"),
            label.alias("label"),
            F.element_at(F.filter("entries", lambda e: e.label == label), -1).keywords.alias("keywords"),
        ),
    )
    return (
        specs.withColumn("entries", F.transform(parts, entry))
        .withColumn("error", error)
        .select(
            "taxonomy_id",
            "topic",
            "error",
            F.explode_outer(F.when(F.col("error").isNull(), categories)).alias("category"),
        )
        .select("taxonomy_id", "topic", "category.priority", "category.label", "category.keywords", "error")
    )


def top_keywords(keywords: Column, k: int = KEYWORDS_IN_DESCRIPTION) -> Column:
    """The first k keywords, with dots when there are more."""
    return F.concat(
        F.array_join(F.slice(keywords, 1, k), ", "), F.when(F.size(keywords) > k, "...").otherwise("")
    )


def _compiled(parsed: DataFrame, *more: str) -> DataFrame:
    return parsed.select(
        "taxonomy_id",
        "priority",
        F.format_string(fixed.CUSTOM_KEY_FORMAT, "priority").alias("key"),
        "label",
        F.concat(F.lit(fixed.DESCRIPTION_PREFIX), F.array_join("keywords", ", ")).alias("description"),
        F.transform("keywords", word_pattern).alias("patterns"),
        *more,
    )


def compile_taxonomies(parsed: DataFrame) -> DataFrame:
    """Parsed specs -> taxonomy rows; specs with an error give none."""
    return _compiled(parsed.filter(F.col("priority").isNotNull()))


def custom_rows(spark: SparkSession, topic: str, spec: str) -> list[Row]:
    """One user specification, compiled, in priority order; ValueError if it is wrong.

    The result is as long as the text the user typed, so it is read to the driver
    and becomes a literal expression.
    """
    parsed = parse_specs(spark.createDataFrame([("custom", topic, spec)], "taxonomy_id string, topic string, spec string"))
    rows = _compiled(parsed, "error").collect()
    failed = [r["error"] for r in rows if r["error"] is not None]
    if failed:
        raise ValueError(failed[0])
    return sorted(rows, key=lambda r: r.priority)


def definitions_text(taxonomies: DataFrame, default_label: str) -> DataFrame:
    """One numbered text per taxonomy that explains its categories, the default last."""
    line = F.format_string("%d. **%s** (key: %s)\n   %s\n", "priority", "label", "key", "description")
    return taxonomies.groupBy("taxonomy_id").agg(
        F.concat(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("priority", line.alias("line")))), lambda x: x.line
                ),
                "\n",
            ),
            F.format_string(
                f"\n%d. **{default_label}** (key: {fixed.DEFAULT_KEY})\n   {fixed.DEFAULT_DESCRIPTION}",
                F.count("*") + 1,
            ),
        ).alias("definitions")
    )


def definitions_json(taxonomies: DataFrame, default_label: str) -> DataFrame:
    """The same as a JSON list of {key, label, description}."""
    item = F.struct("key", "label", "description")
    last = F.struct(
        F.lit(fixed.DEFAULT_KEY).alias("key"),
        F.lit(default_label).alias("label"),
        F.lit(fixed.DEFAULT_DESCRIPTION).alias("description"),
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("priority", item.alias("item")))), lambda x: x.item
    )
    return taxonomies.groupBy("taxonomy_id").agg(
        F.to_json(F.concat(listed, F.array(last))).alias("definitions")
    )
