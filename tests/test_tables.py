import json

import pytest

from topicflow.operators import resume
from topicflow.session import new_dir, shared_dir
from topicflow.sources import tables


def test_csv_with_mark_and_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        '﻿year,conf,title,abstract,category,extra\n2024,ICLR,"a ""q"", b","line 1\nline 2",📚 X,1\n2023,ICML,t,,Y,\n'.encode()
    )
    rows = tables.read_csv(spark, str(tmp_path), tables.SIMPLE).orderBy("year").collect()
    assert [tuple(r) for r in rows] == [(2023, "ICML", "t", "", "Y", None), (2024, "ICLR", 'a "q", b', "line 1\nline 2", "📚 X", "1")]


def test_csv_round_trip(spark):
    values = [("C", 2024, ' "x" \\ ', "a\r\nb, c\n", "研究 ,"), ("C", 2023, "", "\\", ";")]
    path = new_dir(spark, "csv")
    tables.write_csv(spark.createDataFrame(values, tables.SIMPLE), path)
    assert sorted(map(tuple, tables.read_csv(spark, path, tables.SIMPLE).collect())) == sorted(values)


def test_require_columns(spark):
    df = spark.createDataFrame([(1, "x")], "year int, category_label string")
    with pytest.raises(ValueError, match="category"):
        tables.require_columns(df)
    assert tables.require_columns(tables.category_from_label(df)).columns == ["year", "category_label", "category"]


def test_cache_json(spark, tmp_path):
    entry = {"category_key": "k", "category_label": "L", "confidence": 0.5}
    (tmp_path / "ok.json").write_text(json.dumps({"h1": entry, "h2": {**entry, "reasoning": "r"}}, indent=2))
    (tmp_path / "bad.json").write_text('{"h1": {')
    read = lambda name: {tuple(r) for r in tables.read_cache_json(spark, str(tmp_path / name)).collect()}
    assert read("ok.json") == {("h1", "k", "L", 0.5, ""), ("h2", "k", "L", 0.5, "r")}
    assert read("bad.json") == read("missing.json") == set()


def test_cache_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("h1", "a", "A", 0.1, ""), ("h2", "b", "B", 0.2, "")], tables.CACHE)
    new = spark.createDataFrame([("h2", "c", "C", 0.3, ""), ("h3", "d", "D", 0.4, "")], tables.CACHE)
    assert {r.paper_hash: r.category_key for r in tables.upsert_cache(old, new).collect()} == {"h1": "a", "h2": "c", "h3": "d"}


def test_checkpoint_json(spark, tmp_path):
    result = {"id": "1", "conf": "C", "year": 2024, "title": "t", "abstract": "a", "category_key": "k", "category_label": "L", "confidence": 1.0, "reasoning": "r", "method": "rule"}
    (tmp_path / "c.json").write_text(json.dumps({"results": [result], "timestamp": 1.5}, indent=2))
    (row,) = tables.read_checkpoint_json(spark, str(tmp_path / "c.json")).collect()
    assert row.asDict() == result
    assert tables.read_checkpoint_json(spark, str(tmp_path / "none.json")).count() == 0
    assert tables.read_results(spark, str(tmp_path / "none")).count() == 0


def test_detailed_is_stored_by_conference_and_year(spark):
    path = new_dir(spark, "detailed")
    rows = [(str(i), c, y, "t", "a", "k", "L", 1.0, "r", "rule") for i, (c, y) in enumerate([("A", 2023), ("A", 2024), ("B", 2024)])]
    tables.write_detailed(spark.createDataFrame(rows, tables.DETAILED), path)
    pruned = tables.read_results(spark, path).filter("conf = 'A' AND year = 2024")
    assert [r.id for r in pruned.collect()] == ["1"]
    assert len(pruned.inputFiles()) == 3 and "PartitionFilters: [isnotnull(conf" in pruned._jdf.queryExecution().executedPlan().toString()


def test_results_of_both_runs(spark):
    earlier = spark.createDataFrame([("1", "x"), ("9", "gone")], "id string, category_key string")
    todo = resume.filter_unprocessed(spark.createDataFrame([("1",), ("2",)], "id string"), earlier)
    assert {tuple(r) for r in resume.union_results(earlier, todo).collect()} == {("1", "x"), ("9", "gone"), ("2", None)}


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_dir(spark, "x") != new_dir(spark, "x")


@pytest.fixture
def small_splits(spark):
    """Files of a few hundred bytes are read by many tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("64", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def odd_csv(rows):
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(["abstract", "year", "conf", "title", "category"])
    writer.writerows(rows)
    return "\ufeff" + out.getvalue()


def test_csv_is_the_same_in_many_splits(spark, tmp_path, small_splits):
    import random

    own = random.Random(1)
    pieces = ['"', ",", "\n", "a", "bc ", "é", "\n\n", '""', "\r\n", "x" * 90]
    rows = [("".join(own.choices(pieces, k=own.randrange(1, 9))) + ".", 2000 + k, "C", f"t{k}", "K") for k in range(120)]
    rows.append(("\n".join(["a long field"] * 40), 3000, "C", "long", "K"))  # over many splits
    (tmp_path / "a.csv").write_bytes(odd_csv(rows[:70]).encode())
    (tmp_path / "b.csv").write_bytes(odd_csv(rows[70:]).encode())
    got = tables.read_csv(spark, str(tmp_path), tables.SIMPLE)
    assert {r.title: (r.abstract, r.year) for r in got.collect()} == {t: (a, y) for a, y, _, t, _ in rows} and got.count() == len(rows)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 8


def test_bad_values_are_null_and_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("year,conf,title\n20x4,C,a\n2024,C,b\n,C,c\n2023\n")
    got = tables.read_csv(spark, str(tmp_path), tables.SIMPLE).collect()
    assert [(r.year, r.title) for r in sorted(got, key=lambda r: r.title)] == [(2023, ""), (None, "a"), (2024, "b"), (None, "c")]
    (tmp_path / "b.csv").write_text("conf,year,title\nC,2024,d\n")
    with pytest.raises(ValueError, match="headers"):
        tables.read_csv(spark, str(tmp_path), tables.SIMPLE)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.csv").write_text("")
    assert tables.read_csv(spark, str(tmp_path / "empty"), tables.SIMPLE).collect() == []


def test_json_in_many_splits_with_broken_entries(spark, tmp_path, small_splits):
    entries = {f"h{k}": {"category_key": "k{[", "category_label": 'L"}' * (k % 4), "confidence": k / 100, "reasoning": "\\ \"{" * (k % 3)} for k in range(90)}
    text = json.dumps(entries, ensure_ascii=False, indent=2)
    (tmp_path / "a.json").write_text(text)
    got = {r.paper_hash: r.asDict() for r in tables.read_cache_json(spark, str(tmp_path / "a.json")).collect()}
    assert got == {h: {"paper_hash": h, **e} for h, e in entries.items()}
    assert tables.broken_cache_entries(spark, str(tmp_path / "a.json")).count() == 0
    (tmp_path / "b.json").write_text(text.replace('"h7": {', '"h7": nonsense, {', 1))
    assert tables.read_cache_json(spark, str(tmp_path / "b.json")).count() == 89
    assert [("nonsense" in r.text) for r in tables.broken_cache_entries(spark, str(tmp_path / "b.json")).collect()] == [True]
    (tmp_path / "c.json").write_text(text[: len(text) // 2])  # cut off: no cache, all of it reported
    assert tables.read_cache_json(spark, str(tmp_path / "c.json")).count() == 0
    assert tables.broken_cache_entries(spark, str(tmp_path / "c.json")).count() > 40
    (tmp_path / "d.json").write_text(json.dumps(entries))  # in one line
    assert tables.read_cache_json(spark, str(tmp_path / "d.json")).count() == 90
    results = [{"id": str(k), "title": "a]}\n" * (k % 3), "year": k} for k in range(60)]
    (tmp_path / "e.json").write_text(json.dumps({"results": results, "timestamp": 1.0}, indent=2))
    (tmp_path / "f.json").write_text(json.dumps({"results": results, "timestamp": 1.0}))
    for name in ("e.json", "f.json"):
        back = tables.read_checkpoint_json(spark, str(tmp_path / name), "id string, title string, year int")
        assert sorted((r.asDict() for r in back.collect()), key=lambda r: r["year"]) == results


def test_broken_lines_of_a_cache_are_counted(spark, tmp_path):
    entry = {"category_key": "k", "category_label": "L", "confidence": 0.5, "reasoning": ""}
    (tmp_path / "a.txt").write_text("\n".join([json.dumps({"h1": entry}), "{broken", "", json.dumps({"h2": None}), json.dumps({"h3": entry})]))
    path = str(tmp_path / "a.txt")
    assert sorted(r.paper_hash for r in tables.read_cache_json(spark, path, lines=True).collect()) == ["h1", "h3"]
    assert sorted(r.text for r in tables.broken_cache_entries(spark, path, lines=True).collect()) == ['{"h2": null}', "{broken"]
