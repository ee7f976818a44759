"""Whole runs: pages in, report out."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicflow.operators import report
from topicflow.plans.reclassify import reclassify
from topicflow.plans.setup import builtin_setup, custom_setup
from topicflow.plans.trend_report import build_report, classify_papers, collect_papers, score_papers
from topicflow.session import new_dir
from topicflow.sources.landing import requested_pages
from topicflow.sources import tables

TITLES = [
    "A survey of in-context learning",
    "Few-shot agents with tool use",
    "Unrelated vision work",
    "Many-shot prompting",
    "ICL and safety",
]


def note(conf, year, i):
    return {"id": f"n{i}", "content": {"title": {"value": TITLES[i % 5]}, "abstract": f"Abstract {i}", "venue": f"{conf} {year} poster"}}


PAGES = "conf string, year int, candidate int, offset int, payload string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for conf, year, n in [("ICLR", 2023, 25), ("ICLR", 2024, 10), ("ICML", 2024, 5)]:
        for start in range(0, n, 10):
            listed = [note(conf, year, i) for i in range(start, min(n, start + 10))]
            rows.append((conf, year, 3, start * 100, json.dumps({"notes": listed})))
        rows.append((conf, year, 3, 5000, "[]"))
        rows.append((conf, year, 5, 0, json.dumps([note(conf, year, i) for i in range(100)])))
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([("ICLR", 2023), ("ICLR", 2024), ("ICML", 2023), ("ICML", 2024)], "conf string, year int")


@pytest.fixture(scope="module")
def collected(spark, pages, pairs):
    failures = spark.createDataFrame([("ICML", 2023, 1, "timeout"), ("ICML", 2023, 2, "no route")], "conf string, year int, attempt bigint, error string")
    return collect_papers(pages, pairs, builtin_setup(), failures)


def test_collect(collected):
    papers = collected.papers.collect()
    assert len(papers) == 20 + 8 + 4
    assert {r.id for r in papers if r.conf == "ICML"} == {"ICML_2024_n0", "ICML_2024_n1", "ICML_2024_n3", "ICML_2024_n4"}
    log = {(r.conf, r.year): tuple(r)[2:] for r in collected.fetch_log.collect()}
    assert log[("ICLR", 2023)] == ("https://api2.openreview.net", "ICLR.cc/2023/Conference/-/Blind_Submission", 25, 25, None)
    assert log[("ICML", 2023)] == ("", "", 0, 0, "timeout\nno route")
    assert len(log) == 4


def test_pages_are_pruned_to_the_requested_pairs(spark, pages):
    path = new_dir(spark, "pages")
    pages.write.partitionBy("conf", "year").parquet(path)
    stored = spark.read.parquet(path)
    wanted = spark.createDataFrame([("ICML", 2024)], "conf string, year int")
    few = requested_pages(stored, wanted)
    assert "PartitionFilters: [isnotnull(conf" in few._jdf.queryExecution().executedPlan().toString()
    many = requested_pages(stored, wanted, max_listed=0)
    assert {r.conf for r in few.collect()} == {r.conf for r in many.collect()} == {"ICML"}
    assert few.count() == many.count() == 3
    papers = collect_papers(stored, wanted, builtin_setup()).papers
    assert papers.count() == 4


def test_report(spark, collected):
    classified = classify_papers(collected.papers, builtin_setup())
    made = build_report(classified, [2023, 2024, 2025], 2, builtin_setup().long_tail_label)
    assert sum(r.n for r in made.share.collect()) == classified.count() == 32
    trend = made.trend.collect()
    assert {r.year: r.year_total for r in trend} == {2023: 20, 2024: 12, 2025: 0}
    assert len({r.category for r in trend}) == 3
    assert {r.method: r.n for r in made.methods.collect()} == {"rule": 32}
    path = new_dir(spark, "simple")
    tables.write_simple(classified, path)
    again = build_report(tables.read_csv(spark, path, tables.SIMPLE), [2023, 2024, 2025], 2, builtin_setup().long_tail_label)
    assert sorted(map(tuple, again.trend.collect())) == sorted(map(tuple, trend))
    assert again.methods is None


def test_resumed_run_equals_one_run(spark, collected):
    setup = builtin_setup()
    whole = {tuple(r) for r in classify_papers(collected.papers, setup).collect()}
    path = new_dir(spark, "results")
    first = classify_papers(collected.papers.filter("conf = 'ICLR'"), setup, results_path=path)
    assert first.count() == 28
    assert {tuple(r) for r in classify_papers(collected.papers, setup, results_path=path).collect()} == whole
    assert {tuple(r) for r in classify_papers(collected.papers, setup, results_path=path).collect()} == whole
    only = classify_papers(collected.papers.filter("conf = 'ICML'"), setup, results_path=path, keep_earlier=False)
    assert only.count() == 4


def test_another_taxonomy_does_not_reuse_results(spark, collected):
    path = new_dir(spark, "results")
    classify_papers(collected.papers, builtin_setup(), results_path=path)
    custom = custom_setup(spark, "learning", "Agents:agents;Rest:learning")
    got = classify_papers(collected.papers, custom, results_path=path)
    assert {r.category_label for r in got.collect()} == {"Agents", "Rest", "其他/未归类"}


def test_scoring_run(spark, collected, tmp_path):
    calls = str(tmp_path)

    def scorer(frame: pd.DataFrame) -> pd.Series:
        import uuid

        responses = []
        for prompt, ids in zip(frame["prompt"], frame["ids"]):
            (open(f"{calls}/{uuid.uuid4().hex}", "w")).write("\n".join(ids))
            if any(i.startswith("ICML") for i in ids):
                responses.append("down")
            else:
                answers = [{"id": i, "category_key": "efficiency", "confidence": 0.9} for i in ids]
                responses.append(json.dumps({"classifications": answers}))
        return pd.Series(responses)

    setup = builtin_setup()
    papers = collected.papers.withColumn("abstract", F.concat("abstract", F.lit(" "), "conf"))
    empty = spark.createDataFrame([], tables.CACHE)
    first = score_papers(papers, empty, scorer, setup, batch_size=1)
    asked = [p.read_text() for p in tmp_path.iterdir()]
    distinct = papers.select("title", "abstract").distinct().count()
    assert len(asked) == len(set(asked)) == distinct < papers.count()
    assert first.predictions.count() == distinct
    kept = {r.confidence for r in first.cache.collect()}
    assert kept == {0.9}
    failed = distinct - first.cache.count()
    assert failed > 0
    # Once more: only what failed is asked again.
    score_papers(papers, first.cache, scorer, setup, batch_size=1)
    assert len(list(tmp_path.iterdir())) == distinct + failed
    methods = {r.method: r.n for r in report.method_counts(classify_papers(papers, setup, first.predictions)).collect()}
    assert sum(methods.values()) == 32 and set(methods) == {"llm", "rule_fallback"}


def test_reclassify(spark, collected):
    setup = builtin_setup()
    stored = classify_papers(collected.papers, setup).select("id", "title", "abstract", F.col("category_label").alias("category"))
    none = spark.createDataFrame([], tables.CACHE)
    outcome = reclassify(stored, none, setup.rows, setup.default_label)
    assert tuple(outcome.stats.first()) == (32, 0, 32, 0, "0.0")
    assert outcome.changed.count() == 0
    assert sum(r.n for r in outcome.transitions.collect()) == 32
    assert reclassify(stored, none, setup.rows, setup.default_label, n=5).results.count() == 5


def test_reclassify_the_simple_table(spark, collected):
    setup = builtin_setup()
    simple = classify_papers(collected.papers, setup).select("conf", "year", "title", "abstract", F.col("category_label").alias("category"))
    outcome = reclassify(simple.unionByName(simple.limit(3)), spark.createDataFrame([], tables.CACHE), setup.rows, setup.default_label)
    assert outcome.results.count() == 35 and tuple(outcome.stats.first())[:2] == (35, 0)


def test_bad_pages_repeated_pages_and_repeated_pairs(spark):
    def page(candidate, offset, ids):
        notes = [{"id": i, "content": {"title": "In-context learning", "abstract": None, "venue": "ICLR 2024 poster"}} for i in ids]
        return ("ICLR", 2024, candidate, offset, json.dumps(notes))

    rows = [page(1, 0, ["a"]), ("ICLR", 2024, 1, 1000, "<html>"), page(1, 2000, ["b"]), page(3, 0, ["c", "d"]), page(3, 0, ["c", "d"]), page(3, 201_000, ["e"])]
    twice = spark.createDataFrame([("ICLR", 2024), ("ICLR", 2024), ("ICML", 2024)], "conf string, year int")
    found = collect_papers(spark.createDataFrame(rows, PAGES), twice, builtin_setup())
    assert sorted(r.id for r in found.papers.collect()) == ["ICLR_2024_c", "ICLR_2024_d", "ICLR_2024_e"]
    log = {r.conf: (r.submissions, r.accepted, r.error) for r in found.fetch_log.collect()}
    assert log == {"ICLR": (3, 3, None), "ICML": (0, 0, "Nothing listed")}
    failed = collect_papers(spark.createDataFrame(rows[:3], PAGES), twice, builtin_setup()).fetch_log.filter("conf = 'ICLR'").first()
    assert (failed.accepted, failed.error) == (0, "Non-JSON response. Head: <html>")


def test_own_predicate(spark, pages, pairs):
    found = collect_papers(pages, pairs, builtin_setup(), keep=lambda title, abstract: abstract == "Abstract 3")
    assert found.papers.count() == 3
