import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicflow.operators import joins, scoring, taxonomy
from topicflow.sources import tables

CACHE = "paper_hash string, category_key string, category_label string, confidence double, reasoning string"


@pytest.fixture(scope="module")
def rows(spark):
    return taxonomy.custom_rows(spark, "t", "Red:red;Blue:blue")


def papers(spark, values):
    return spark.createDataFrame(values, "id string, title string, abstract string")


def predictions(spark, values):
    """(title, abstract, key, label, confidence) -> predictions by hash."""
    df = spark.createDataFrame(values, "title string, abstract string, category_key string, category_label string, confidence double")
    return scoring.with_hash(df).select("paper_hash", "category_key", "category_label", "confidence", F.lit("seen").alias("reasoning"))


def test_paper_hash(spark):
    import hashlib

    df = scoring.with_hash(papers(spark, [("1", "é", "研究"), ("2", "", "")]))
    assert {r.id: r.paper_hash for r in df.collect()} == {
        "1": hashlib.md5("é|||研究".encode()).hexdigest(),
        "2": hashlib.md5(b"|||").hexdigest(),
    }


def test_cache_join_pairs_by_text_not_by_position(spark):
    """A partial cache hit and copies of one text get their own result each."""
    df = papers(spark, [("1", "a", ""), ("2", "b", ""), ("3", "a", ""), ("4", "c", "")])
    cache = predictions(spark, [("a", "", "custom_1", "Red", 0.9), ("c", "", "custom_2", "Blue", 0.8)])
    got = {r.id: (r.category_key, r.from_cache) for r in scoring.cache_join(df, cache).collect()}
    assert got == {"1": ("custom_1", True), "2": (None, False), "3": ("custom_1", True), "4": ("custom_2", True)}
    todo = scoring.to_score(papers(spark, [("9", "b", ""), ("5", "b", ""), ("1", "a", "")]), cache).collect()
    assert [(r.id, r.title) for r in todo] == [("5", "b")]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_keys_are_split_without_changing_the_result(spark, how):
    left = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string")).alias("k"),
        F.col("id").cast("string").alias("id"),
    )
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("2", 3), ("7", 4), ("none", 5)], "k string, v int")
    want = sorted(map(tuple, left.join(right, "k", how).select(sorted(left.join(right, "k", how).columns)).na.fill("").na.fill(0).collect()))
    split = joins.join_skewed(left, right, "k", "id", how, max_rows=2, rows_per_split=100)
    assert sorted(map(tuple, split.select(sorted(split.columns)).na.fill("").na.fill(0).collect())) == want


def test_join_bounded_broadcasts_only_below_the_bound(spark):
    left, right = spark.range(50).withColumnRenamed("id", "k"), spark.range(20).withColumnRenamed("id", "k")
    hinted = joins.join_bounded(left, right, "k", "inner")
    plain = joins.join_bounded(left, right, "k", "inner", max_rows=10)
    assert joins.is_small(right) and not joins.is_small(right, max_bytes=50) and joins.is_small(right.limit(0))
    assert "ResolvedHint" in hinted._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plain._jdf.queryExecution().analyzed().toString()
    assert hinted.count() == plain.count() == 20


def test_batches(spark):
    df = scoring.with_hash(papers(spark, [(str(i), f"t{i}", "a") for i in range(237)]))
    batched = scoring.score_batches(df, 10, buckets=4).collect()
    sizes: dict = {}
    for r in batched:
        sizes.setdefault((r.bucket, r.batch_no), set()).add(r.position)
    assert sum(map(len, sizes.values())) == 237
    assert all(p == set(range(len(p))) and len(p) <= 10 for p in sizes.values())
    per_bucket = {b: [len(p) for (bb, _), p in sizes.items() if bb == b] for b, _ in sizes}
    assert all(sorted(v)[1:] == [10] * (len(v) - 1) for v in per_bucket.values())
    again = scoring.score_batches(df.repartition(5), 10, buckets=4).collect()
    assert {(r.id, r.bucket, r.batch_no, r.position) for r in again} == {(r.id, r.bucket, r.batch_no, r.position) for r in batched}


def test_prompt(spark):
    df = scoring.with_hash(papers(spark, [("1", "First", "x" * 600), ("2", "Second", "")]))
    row = scoring.build_prompts(scoring.score_batches(df, 10, 1), "1. **Red**").first()
    assert sorted(row.ids) == ["1", "2"]
    assert f"Paper ID: 1\nTitle: First\nAbstract: {'x' * 600}\n" in row.prompt + "\n"
    assert "Paper ID: 2\nTitle: Second\nAbstract: " in row.prompt
    assert "分类标准：\n1. **Red**\n\n待分类论文：\nPaper ID: " in row.prompt
    assert row.prompt.startswith("你是") and row.prompt.endswith("（0-1之间）\n")


def parse(spark, rows, ids, response):
    df = spark.createDataFrame([(0, 0, ids, response)], "bucket int, batch_no int, ids array<string>, response string")
    return {r.id: r for r in scoring.parse_responses(df, rows, "Other").collect()}


def test_responses(spark, rows):
    answers = [
        {"id": "3", "category_key": "custom_2", "confidence": 0.7, "reasoning": "r3"},
        {"id": "1", "category_key": "custom_1", "confidence": 1},
        {"id": "2"},
        {"id": "1", "category_key": "custom_2"},
        {"id": "5", "category_key": "made_up", "confidence": 0.9, "reasoning": "r5"},
    ]
    got = parse(spark, rows, ["1", "2", "3", "4", "5"], json.dumps({"classifications": answers}))
    assert {i: tuple(r)[1:] for i, r in got.items()} == {
        "1": ("custom_1", "Red", 1.0, "", False),
        "2": ("other", "Other", 0.5, "", False),
        "3": ("custom_2", "Blue", 0.7, "r3", False),
        "4": ("other", "Other", 0.0, "No classification returned", False),
        "5": ("made_up", "Other", 0.9, "r5", False),
    }


@pytest.mark.parametrize(
    "response, reason",
    [("oops " * 40, "API Error: " + "oops " * 40), (None, "API Error: no response"), ('{"classifications": [', 'API Error: {"classifications": [')],
)
def test_failed_batch(spark, rows, response, reason):
    got = parse(spark, rows, ["1", "2"], response)
    assert {tuple(r)[1:] for r in got.values()} == {("other", "Other", 0.0, reason, True)}


def test_response_without_a_list_of_answers_is_a_failure(spark, rows):
    for response in ("{}", "[]"):
        got = parse(spark, rows, ["1"], response)
        assert tuple(got["1"])[1:] == ("other", "Other", 0.0, f"API Error: {response}", True)
    got = parse(spark, rows, ["1"], '{"classifications": []}')
    assert tuple(got["1"])[1:] == ("other", "Other", 0.0, "No classification returned", False)


def test_hybrid_threshold(spark, rows):
    df = papers(spark, [("low", "a red", ""), ("edge", "b blue", ""), ("none", "c red", ""), ("high", "d", "x")])
    scores = predictions(
        spark, [("a red", "", "custom_2", "Blue", 0.59), ("b blue", "", "custom_1", "Red", 0.6), ("d", "x", "k", "L", 0.95)]
    )
    got = {r.id: tuple(r)[3:] for r in scoring.hybrid_classify(df, scores, rows, "Other").collect()}
    assert got == {
        "low": ("custom_1", "Red", 0.5, "LLM low confidence (0.59), used rule", "rule_fallback"),
        "edge": ("custom_1", "Red", 0.6, "seen", "llm"),
        "none": ("custom_1", "Red", 0.5, "LLM low confidence (0.00), used rule", "rule_fallback"),
        "high": ("k", "L", 0.95, "seen", "llm"),
    }


def test_without_scorer_all_is_by_rule(spark, rows):
    (row,) = scoring.hybrid_classify(papers(spark, [("1", "x", "blue")]), None, rows, "Other").collect()
    assert tuple(row)[3:] == ("custom_2", "Blue", 1.0, "Rule-based classification", "rule")


def test_scorer_runs_once_per_batch_frame(spark):
    def scorer(frame: pd.DataFrame) -> pd.Series:
        return frame["ids"].map(len).astype(str)

    df = scoring.with_hash(papers(spark, [(str(i), f"t{i}", "a") for i in range(25)]))
    responses = scoring.apply_scorer(scoring.build_prompts(scoring.score_batches(df, 10, 1), "d"), scorer).collect()
    assert sorted(r.response for r in responses) == ["10", "10", "5"]


def test_repeated_papers_and_ids_are_scored_once_per_text(spark):
    cache = spark.createDataFrame([], tables.CACHE)
    rows = papers(spark, [("1", "a", None), ("1", "a", ""), ("2", "b", ""), ("2", "c", "")])
    todo = {r.id: r.title for r in scoring.to_score(rows, cache).collect()}
    assert sorted(todo.values()) == ["a", "b", "c"] and len(todo) == 3 and todo["1"] == "a"


def test_a_scorer_that_raises_fails_its_own_batch(spark):
    def scorer(frame):
        if (frame["batch_no"] == 1).any():
            raise RuntimeError("no route")
        return frame["prompt"].map(lambda p: '{"classifications": []}' if p == "x" else "[]")

    prompts = spark.createDataFrame([(0, k, [str(k)], p) for k, p in enumerate("xyz")], "bucket int, batch_no int, ids array<string>, prompt string").coalesce(1)
    parsed = scoring.parse_responses(scoring.apply_scorer(prompts, lambda f: scorer(f)), [], "Other").withColumn("cached", scoring.was_answered())
    got = {r.id: (r.failed, r.reasoning, r.cached) for r in parsed.collect()}
    assert got == {"0": (False, "No classification returned", False), "1": (True, "API Error: RuntimeError: no route", False), "2": (True, "API Error: []", False)}
