import random
from collections import Counter

import pytest

from topicflow.functions import text
from topicflow.operators import compare, report
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    names = ["📚 Alpha", "Beta", "🛡️ Gamma", "Delta", "Eps", "Old"]
    rows = [(rng.choice([2021, 2022, 2023, 2024]), rng.choices(names[:5], [50, 20, 10, 3, 3])[0]) for _ in range(700)]
    rows += [(1999, "Old")] * 9 + [(2022, None)] * 4 + [(None, "Beta")] * 3
    return rows, spark.createDataFrame(rows, "year int, category string")


def test_share(data):
    rows, df = data
    want = Counter(c for _, c in rows if c)
    total = sum(want.values())
    got = report.category_share(df).collect()
    assert {r.category: r.n for r in got} == want
    for r in got:
        assert r.pct == pytest.approx(100 * r.n / total)
        assert r.pct_label == (f"{r.pct:.1f}%" if r.pct >= 2 else "")
        assert r.display == r.category.split(" ")[-1]
    assert [r.category for r in report.category_counts(df).collect()] == sorted(want, key=lambda c: (-want[c], c))


@pytest.mark.parametrize("k", [1, 3, 5, 6, 12])
def test_trend(data, k):
    rows, df = data
    years = [2023, 2021, 2030]
    counts = Counter((y, c) for y, c in rows if y and c)
    names = {c for y, c in rows if c and y}
    totals = {c: sum(counts[y, c] for y in years) for c in names}
    kept = sorted(names, key=lambda c: (-totals[c], c))[:k]
    want = {(y, c): counts[y, c] for y in years for c in kept}
    if len(names) > k:
        want |= {(y, "rest"): sum(counts[y, c] for c in names if c not in kept) for y in years}
    got = report.topk_trend(df, years, k, "rest").collect()
    assert {(r.year, r.category): r["count"] for r in got} == want
    assert len(got) == len(want)
    for r in got:
        assert r.year_total == sum(counts[r.year, c] for c in names)
        assert r.is_other == (r.category == "rest")


def test_long_tail_series_may_share_a_category_name(spark):
    df = spark.createDataFrame([(1, "rest")] * 3 + [(1, "b")] * 2 + [(1, "c")], "year int, category string")
    got = {(r.category, r.is_other): r["count"] for r in report.topk_trend(df, [1], 1, "rest").collect()}
    assert got == {("rest", False): 3, ("rest", True): 3}


def test_k_must_be_positive(data):
    with pytest.raises(ValueError):
        report.topk_trend(data[1], [2021], 0)


def test_spine_and_pivot(data):
    rows, df = data
    years = [2030, 2022, 2021]
    spine = report.year_spine(df, years).collect()
    counts = Counter(rows)
    assert {(r.year, r.position, r.category): r["count"] for r in spine} == {
        (y, i, c): counts[y, c] for i, y in enumerate(years) for c in {c for y, c in rows if c and y}
    }
    pivot = report.year_category_pivot(df, ["Beta", "Eps", "absent"]).collect()
    assert [r.year for r in pivot] == [1999, 2021, 2022, 2023, 2024]
    assert all(r.Beta == counts[r.year, "Beta"] and r.absent == 0 for r in pivot)
    assert report.restrict_years(df, [1999]).count() == 9
    assert tuple(report.year_range(df).first()) == (1999, 2024)


@pytest.mark.parametrize("pct, label", [(1.999, ""), (2.0, "2.0%"), (12.25, "12.2%"), (12.35, "12.3%"), (0.05, ""), (100.0, "100.0%"), (62.75, "62.8%")])
def test_pct_label_rounds_like_python(spark, pct, label):
    assert label == (f"{pct:.1f}%" if pct >= 2 else "")
    assert spark.range(1).select(text.pct_label(F.lit(pct)).alias("l")).first().l == label


@pytest.mark.parametrize("label, shown", [("📚 Prompt工程", "Prompt工程"), ("🛡️  可靠性", "可靠性"), ("é b ", "b"), ("2 x", "2 x"), ("🧺", ""), ("-- 9", "9")])
def test_display_label(spark, label, shown):
    assert spark.createDataFrame([(label,)], "s string").select(text.display_label(F.col("s")).alias("d")).first().d == shown


def test_strip_equals_python(spark):
    chars = [c for c in map(chr, range(0x3100)) if c.isspace()] + ["​", "a", "﻿", "\x00"]
    df = spark.createDataFrame([(i, f"{c}x y{c}{c}") for i, c in enumerate(chars)], "i int, s string")
    for r in df.select("i", "s", text.strip(F.col("s")).alias("t")).collect():
        assert r.t == r.s.strip(), hex(ord(chars[r.i]))


def test_compare(spark):
    old = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", None), ("4", "A")], "id string, category string")
    new = spark.createDataFrame(
        [("4", "t" * 70, "A", 1.0, "x", "rule"), ("3", "t", "C", 0.9, "y", "llm"), ("2", "t", "A", 0.5, "z" * 120, "rule_fallback"), ("1", "t", "A", 0.8, "", "llm")],
        "id string, title string, category_label string, confidence double, reasoning string, method string",
    )
    compared = compare.compare_join(old, new)
    assert tuple(compare.reclass_stats(compared).first()) == (4, 2, 2, 2, "50.0")
    changed = {r.id: r for r in compare.changed_only(compared).collect()}
    assert set(changed) == {"2", "3"} and changed["2"].reasoning == "z" * 100 + "..."
    assert {tuple(r) for r in compare.label_transitions(compared).collect()} == {("A", "A", 2), ("B", "A", 1), (None, "C", 1)}
    assert [r.id for r in compare.sample_head(new, 2).collect()] == ["1", "2"]
    assert compare.sample_head(new, None).count() == 4
