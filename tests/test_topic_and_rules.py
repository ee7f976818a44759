import pytest
from pyspark.sql import functions as F

from topicflow.functions import fixed
from topicflow.operators import classify, pattern_index, taxonomy, topic

TOPIC_TEXTS = [
    ("In-context learning enables few-shot learning", True),
    ("This paper studies neural networks", False),
    ("We propose a method for ICL in transformers", True),
    ("Deep learning for computer vision", False),
    ("ICL相关 研究", False),
]

RULE_TEXTS = [
    ("Chain-of-thought prompting improves reasoning in large language models", "", "reasoning_cot"),
    ("A benchmark for evaluating in-context learning capabilities", "", "evaluation"),
    ("Understanding the mechanism of in-context learning through attention analysis", "", "mechanism_theory"),
    ("Efficient prompt compression for long-context language models", "", "efficiency"),
    (
        "Chain-of-Thought Prompting",
        "We propose chain-of-thought prompting to improve reasoning in large language models through in-context learning.",
        "reasoning_cot",
    ),
    (
        "ICL Benchmark",
        "A comprehensive benchmark for evaluating in-context learning capabilities of language models.",
        "evaluation",
    ),
    ("Tool use with few-shot demos", "", "application_agent"),
    ("Benchmark notes", "ICL everywhere", "other"),
    ("KV cache tricks", "few-shot prompts", "efficiency"),
    ("Calibrated ICL", "privacy", "reliability_safety"),
    ("Training transformers in context", "", "model_training"),
    ("Plain ICL", "nothing else", "other"),
]


def papers(spark, rows):
    return spark.createDataFrame([(str(i), t, a) for i, (t, a) in enumerate(rows)], "id string, title string, abstract string")


def test_default_topic(spark):
    kept = topic.filter_topic(papers(spark, [(t, "") for t, _ in TOPIC_TEXTS]))
    assert {r.title for r in kept.collect()} == {t for t, on in TOPIC_TEXTS if on}


def test_any_word_of_the_topic_or_a_variant_is_enough(spark):
    rows = [("Learning to rank", ""), ("multimodal", ""), ("Learnings", ""), ("unlearning", ""), ("x", "Multimodaled y")]
    kept = topic.filter_topic(papers(spark, rows), "multimodal learning")
    assert {r.id for r in kept.collect()} == {"0", "1", "2", "4"}


def test_topic_of_separators_matches_everything(spark):
    assert topic.filter_topic(papers(spark, [("a", ""), ("", "")]), " , ").count() == 2


def test_builtin_rules(spark):
    rows = [(t, a) for t, a, _ in RULE_TEXTS]
    got = classify.classify_rules(papers(spark, rows), taxonomy.builtin_rows(), fixed.BUILTIN_DEFAULT_LABEL)
    labels = {r.key: r.label for r in taxonomy.builtin_rows()} | {"other": fixed.BUILTIN_DEFAULT_LABEL}
    for r in got.collect():
        key = RULE_TEXTS[int(r.id)][2]
        assert (r.category_key, r.category_label) == (key, labels[key]), r.title


def test_builtin_taxonomy_shape(spark):
    rows = taxonomy.builtin_rows()
    assert [(r.key, len(r.patterns)) for r in rows] == [
        ("evaluation", 6), ("application_agent", 7), ("reasoning_cot", 8), ("prompt_eng", 7), ("specific_methods", 10),
        ("efficiency", 11), ("reliability_safety", 9), ("mechanism_theory", 8), ("model_training", 10),
    ]
    assert taxonomy.builtin_table(spark).count() == 9


def test_several_taxonomies_give_a_row_each_also_without_a_match(spark):
    specs = spark.createDataFrame(
        [("a", "t", "X:red;Y:blue"), ("b", "t", "Z:blue"), ("c", "t", "W:green")],
        "taxonomy_id string, topic string, spec string",
    )
    compiled = taxonomy.compile_taxonomies(taxonomy.parse_specs(specs))
    df = papers(spark, [("red and blue", ""), ("blue", ""), ("none", "")])
    got = pattern_index.classify_many(df, compiled, "other", "Other").collect()
    assert {(r.id, r.taxonomy_id, r.category_label) for r in got} == {
        ("0", "a", "X"), ("0", "b", "Z"), ("0", "c", "Other"), ("1", "a", "Y"), ("1", "b", "Z"), ("1", "c", "Other"),
        ("2", "a", "Other"), ("2", "b", "Other"), ("2", "c", "Other"),
    }
    assert len(got) == 9


def test_rules_search_a_text_once_per_category(spark):
    """Neither the filter on topic nor a null test on the category repeats the search."""
    from topicflow.operators import report

    df = spark.range(1).select(F.col("id").cast("string"), F.lit(2024).alias("year"), F.uuid().alias("title"), F.uuid().alias("abstract"))
    classified = classify.classify_rules(df, taxonomy.builtin_rows(), "x").withColumnRenamed("category_label", "category")
    plan = report.year_category_counts(classified)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 10


@pytest.mark.parametrize("key, label", [("evaluation", "📊 评测基准与数据集"), ("nonsense", "🧺 其他/未归类")])
def test_lookup_category(spark, key, label):
    keys = spark.createDataFrame([(key,)], "category_key string")
    row = classify.lookup_category(keys, taxonomy.builtin_table(spark), fixed.BUILTIN_DEFAULT_LABEL).first()
    assert row.category_label == label
