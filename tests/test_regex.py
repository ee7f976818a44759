"""Pattern search against Python's re, which defines the expected result."""

import random
import re

import pytest
from pyspark.sql import functions as F

from topicflow.functions import fixed
from topicflow.functions.regex import FLAGS, alternation, matches_any, word_pattern
from topicflow.operators import taxonomy
from topicflow.operators.classify import match_evidence, rule_priority

EDGE_TEXTS = [
    "theory of x\rICL", "theory of x\nICL", "theory of x\x85ICL", "theory of x ICL",
    "Kv cache", "meaſure", "safetyé", "safety_", "safety", "SAFETY.", "",
    "ICL相关 研究", "an ICL 研究", "k-NN for ICL", "knn and in context", "k nn few shot ICL",
    "(few-shot)agents", "agents use few-shot", "few-shot agents", "flashattention", "flash-attention",
    "in-context autoencoder", "autoencoder", "reasoner with a chain", "meta-learning", "prototypes", "prototype",
    "composed demonstrations", "select examples", "selecting exemplars", "train short and infer long",
    "RoPE base scaling", "scaling RoPE", "trajectory", "API usage", "api calls", "uncertainty", "tooluse", "tool use",
]


def pattern_words() -> list[str]:
    """The words of the built-in patterns, as material for random texts."""
    text = " ".join(p for r in taxonomy.builtin_rows() for p in r.patterns)
    return sorted(set(re.findall(r"[A-Za-z]{2,}", text.replace(r"\b", " ").replace(r"\w", " "))))


def random_texts(n: int) -> list[str]:
    rng = random.Random(7)
    words = pattern_words()
    joints = [" "] * 12 + ["-", "-", "\n", ". ", "_", "s ", "é ", "  ", " the "]
    return ["".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def expected_priority(text: str):
    for row in taxonomy.builtin_rows():
        if any(re.search(p, text, re.IGNORECASE) for p in row.patterns):
            return row.priority
    return None


@pytest.fixture(scope="module")
def texts(spark):
    values = EDGE_TEXTS + random_texts(3000)
    return values, spark.createDataFrame(list(enumerate(values)), "n int, text string")


def test_rule_priority_equals_first_matching_category(texts):
    values, df = texts
    got = {r.n: r.p for r in df.select("n", rule_priority(F.col("text"), taxonomy.builtin_rows()).alias("p")).collect()}
    wrong = [(values[n], p, expected_priority(values[n])) for n, p in got.items() if p != expected_priority(values[n])]
    assert not wrong
    assert set(got.values()) == {None, *range(1, 10)}


def test_every_builtin_pattern_alone(texts):
    values, df = texts
    patterns = [p for r in taxonomy.builtin_rows() for p in r.patterns] + list(fixed.DEFAULT_TOPIC_PATTERNS)
    columns = [matches_any(F.col("text"), [p]).alias(f"p{i}") for i, p in enumerate(patterns)]
    for row in df.select("n", *columns).collect():
        for i, p in enumerate(patterns):
            assert row[f"p{i}"] == bool(re.search(p, values[row.n], re.IGNORECASE)), (p, values[row.n])


def test_evidence_lists_all_patterns_and_what_they_found(texts):
    values, df = texts
    papers = df.select(F.col("n").cast("string").alias("id"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    got = {
        (int(r.id), r.category_key, r.pattern_no): r.found
        for r in match_evidence(papers, taxonomy.builtin_rows()).collect()
    }
    want = {}
    for n, text in enumerate(values):
        for row in taxonomy.builtin_rows():
            for i, p in enumerate(row.patterns, 1):
                if found := re.search(p, "\n" + text, re.IGNORECASE):
                    want[n, row.key, i] = found.group(0)
    assert got == want


@pytest.mark.parametrize(
    "patterns",
    [
        [r"\bcat\b|\b(cow|dog)s\b"],
        [r"\b(un)?able\b", r"\babl\w*", r"free|\bfr(e|a)me\b"],
        [r"\b[ab]c\b", r"\babc?d\b", r"\ba\|b\b", r"\b(a|(b|c)d)e\b", r"\bab*c\b"],
        [r"\bc\+\+\b", r"\b\#tag\b", r"\bx\ y\b", r"\b研究\b"],
    ],
)
def test_alternation_keeps_the_meaning(spark, patterns):
    rng = random.Random(3)
    alphabet = ["a", "b", "c", "d", "e", "cat", "cow", "dogs", "able", "un", "fr", "me", " ", " ", "|", "c++", "#tag", "x y", "研究"]
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in values], "text string")
    got = {r.text: r.hit for r in df.select("text", matches_any(F.col("text"), patterns).alias("hit")).collect()}
    for v in values:
        assert got[v] == any(re.search(p, v, re.IGNORECASE) for p in patterns), v


def test_alternation_shares_beginnings():
    assert alternation([r"\bcat\b|\b(cow|dog)s\b"]) == FLAGS + r"(?:\b(?=[cd])(?:c(?:at\b|ows\b)|dogs\b))"


def test_word_pattern_escapes_like_python(spark):
    words = ["c++", "#tag", "a.b", "x y", "a-b", "研究", "é!", "50%", "a_b", "t\\n", "q?", "(x)", "a&b~c", "'\"@,/:;<=>`"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", word_pattern(F.col("w")).alias("p")).collect():
        assert r.p == r"\b" + re.escape(r.w) + r"\b"
