"""Keyword expressions: normal form, variants, and keywords hidden in a label."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicflow.functions.fixed import LABEL_STEMS
from topicflow.functions.text import strip

# What separates words in a label and in a topic.
LABEL_SEPARATORS = r"(?U)[、，,：:；;\s\x1c-\x1f]+"
TOPIC_SEPARATORS = r"(?U)[,\s\x1c-\x1f]+"
ENGLISH_WORD = "^[a-zA-Z-]+$"


def normalize_keyword(keyword: Column) -> Column:
    return F.lower(strip(keyword))


def keyword_variants(keyword: Column) -> Column:
    """The keyword with its plural, -ing, -ed and hyphen/space forms, without repeats."""
    lowered = F.lower(keyword)
    size = F.length(keyword)
    all_but_last = F.substring(keyword, F.lit(1), size - 1)
    ends_in_e = F.endswith(lowered, F.lit("e"))
    longer_than_3 = size > 3
    hyphen, space = F.lit("-"), F.lit(" ")
    has_hyphen, has_space = F.contains(keyword, hyphen), F.contains(keyword, space)
    forms = F.array(
        keyword,
        F.when(~F.endswith(lowered, F.lit("s")), F.concat(keyword, F.lit("s"))),
        F.when(F.endswith(lowered, F.lit("y")) & (size > 2), F.concat(all_but_last, F.lit("ies"))),
        F.when(longer_than_3, F.concat(F.when(ends_in_e, all_but_last).otherwise(keyword), F.lit("ing"))),
        F.when(longer_than_3, F.concat(keyword, F.when(ends_in_e, "d").otherwise("ed"))),
        F.when(has_hyphen, F.replace(keyword, hyphen, space)),
        F.when(has_hyphen, F.replace(keyword, hyphen, F.lit(""))),
        F.when(has_space, F.replace(keyword, space, hyphen)),
        F.when(has_space, F.replace(keyword, space, F.lit(""))),
    )
    return F.array_distinct(F.array_compact(forms))


def words(text: Column, separators: str) -> Column:
    return F.filter(F.split(text, separators), lambda w: w != "")


def label_keywords(label: Column) -> Column:
    """English words for the Chinese stems in a label, its own words, and their variants."""
    from_stems = [
        F.when(F.contains(label, F.lit(stem)), F.array(*map(F.lit, english))).otherwise(
            F.array().cast("array<string>")
        )
        for stem, english in LABEL_STEMS
    ]
    own = F.transform(
        words(label, LABEL_SEPARATORS),
        lambda w: F.when(F.rlike(w, F.lit(ENGLISH_WORD)), keyword_variants(w)).otherwise(F.array(w)),
    )
    return F.array_sort(F.array_distinct(F.concat(*from_stems, F.flatten(own))))


def user_keywords(keywords: Column) -> Column:
    """A comma-separated keyword list in normal form, blanks dropped."""
    return F.filter(F.transform(F.split(keywords, ","), normalize_keyword), lambda k: k != "")


def topic_words(topic: Column) -> Column:
    return words(topic, TOPIC_SEPARATORS)
