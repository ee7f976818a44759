import json

import pytest
from pyspark.sql import functions as F

from topicflow.sources import landing

NOTES = [
    # note, title, abstract
    ({"id": "1", "content": {"title": " T ", "abstract": "A\n"}}, "T", "A"),
    ({"id": "2", "content": {"title": {"value": "T"}, "abstract": {"value": " A　"}}}, "T", "A"),
    ({"id": "3", "content": {"title": {"value": None}, "abstract": None}}, "", ""),
    ({"id": "4"}, "", ""),
    ({"id": "5", "content": None}, "", ""),
    ({"content": {"title": "T", "abstract": " ", "TL;DR": " short "}}, "T", "short"),
    ({"id": "7", "content": {"title": "T", "TL;DR": "", "TLDR": "other"}}, "T", "other"),
    ({"id": "8", "content": {"title": "T", "TL;DR": {"value": ""}, "TLDR": "other"}}, "T", ""),
    ({"id": "9", "content": {"title": "T", "TL;DR": {}, "TLDR": {"value": "other"}}}, "T", "other"),
    ({"id": "10", "content": {"title": "T", "TL;DR": None, "TLDR": "other"}}, "T", "other"),
    ({"id": "11", "content": {"title": "T", "abstract": "A", "TL;DR": "short"}}, "T", "A"),
    ({"id": "12", "content": {"title": '{"value": "x"}', "abstract": {}}}, '{"value": "x"}', ""),
    ({"id": "13", "content": {"title": 7, "abstract": {"other": 1}}}, "7", ""),
]


def pages(spark, rows):
    schema = "conf string, year int, candidate int, offset bigint, payload string"
    return spark.createDataFrame(rows, schema)


def notes(spark, values, conf="ICLR", year=2024):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "n int, note string")
    return df.select("n", F.lit(conf).alias("conf"), F.lit(year).alias("year"), F.parse_json("note").alias("note"))


def test_normalize_note(spark):
    got = landing.normalize_note(notes(spark, [n for n, _, _ in NOTES])).orderBy("n").collect()
    assert [(r.note_id, r.title, r.abstract) for r in got] == [(n.get("id"), t, a) for n, t, a in NOTES]


@pytest.mark.parametrize(
    "content, accepted, strict, filtered",
    [
        ({"venueid": "ICLR.cc/2024/Conference"}, True, True, True),
        ({"venueid": {"value": "ICLR.cc/2024/Conference"}}, False, True, True),
        ({"venueid": {"value": "ICLR.cc/2024/Conference"}, "venue": {"value": "ICLR 2024 poster"}}, True, True, True),
        ({"venue": "Submitted to ICLR 2024"}, True, True, False),
        ({"venue": "iclr 2024"}, False, False, False),
        ({"venue": "Accept (oral)"}, True, True, False),
        ({"venue": "not ACCEPTED"}, True, True, False),
        ({"venueid": "ICLR.cc/2023/Conference", "venue": "ICLR 2023"}, False, False, False),
        ({"venue": None}, False, False, False),
        ({}, False, False, False),
    ],
)
def test_accepted(spark, content, accepted, strict, filtered):
    df = notes(spark, [{"id": "x", "content": content}])
    assert landing.filter_accepted(df).count() == accepted
    assert landing.filter_accepted(df, strict=True).count() == strict
    assert landing.filter_venueid(df).count() == filtered


@pytest.mark.parametrize(
    "payload, n",
    [
        ('[{"id": "a"}, {"id": "b"}]', 2),
        ('{"notes": [], "data": [{"id": "a"}]}', 0),
        ('{"notes": {"x": 1}, "data": [{"id": "a"}]}', 1),
        ('{"results": [{"id": "a"}]}', 1),
        ('{"other": [{"id": "a"}]}', 0),
        ('"text"', 0),
        ("[]", 0),
    ],
)
def test_note_list(spark, payload, n):
    assert landing.page_sizes(pages(spark, [("C", 2024, 0, 0, payload)])).first().n == n


def test_bad_payload_keeps_the_head_on_one_line(spark):
    rows = [("C", 2024, 0, 0, "<html>\n" + "x" * 500), ("C", 2024, 0, 1000, "[]"), ("C", 2024, 0, 2000, "null")]
    (bad,) = landing.bad_payloads(pages(spark, rows)).collect()
    assert bad.error == "Non-JSON response. Head: <html> " + "x" * 393


def listing(n, start=0, **content):
    return json.dumps([{"id": f"n{start + i}", "content": {"title": f"T{start + i}", **content}} for i in range(n)])


def test_pages_until_empty(spark):
    rows = [("C", 2024, 1, o * 1000, listing(n)) for o, n in enumerate([2, 1, 2, 0, 2])]
    rows += [("C", 2024, 2, o * 1000, listing(1)) for o in (0, 1, 200, 201)]
    rows += [("C", 2024, 3, 0, listing(0)), ("C", 2024, 3, 1000, listing(1))]
    kept = {(r.candidate, r.offset) for r in landing.pages_until_empty(pages(spark, rows)).collect()}
    assert kept == {(1, 0), (1, 1000), (1, 2000), (2, 0), (2, 1000), (2, 200_000), (2, 201_000)}
    assert landing.pages_until_empty(pages(spark, rows), 200_000).filter("candidate = 2").count() == 3


def test_first_success(spark):
    rows = [
        ("A", 2024, 1, 0, listing(3, venue="rejected")),  # listed, none accepted
        ("A", 2024, 3, 0, listing(2, venue="A 2024 poster")),  # the winner
        ("A", 2024, 4, 0, listing(5)),  # later, through the filter
        ("B", 2024, 2, 0, listing(4)),  # filtered by venue id: all accepted, total unknown
        ("B", 2024, 2, 1000, listing(3)),
        ("B", 2024, 2, 2000, listing(0)),
        ("B", 2024, 2, 3000, listing(9)),  # past the end of the listing
        ("C", 2024, 1, 0, listing(1, venue="rejected")),
        ("D", 2024, 0, 0, listing(0)),
        ("D", 2024, 0, 1000, listing(2)),
        ("D", 2024, 1, 0, listing(1, venue="Accept")),
    ]
    counts = landing.candidate_counts(landing.page_summary(pages(spark, rows)))
    got = {r.conf: (r.candidate, r.submissions, r.accepted) for r in landing.first_success(counts).collect()}
    assert got == {"A": (3, 2, 2), "B": (2, -1, 7), "D": (1, 1, 1)}
    winners = landing.first_success(counts)
    chosen = landing.accepted_notes(pages(spark, rows), winners)
    assert {r.conf: r["count"] for r in chosen.groupBy("conf").count().collect()} == {"A": 2, "B": 7, "D": 1}


def test_fetch_plan_order(spark):
    plan = landing.fetch_plan(spark.createDataFrame([("ICLR", 2024)], "conf string, year int")).orderBy("candidate").collect()
    assert [p.candidate for p in plan] == list(range(24))
    assert (plan[0].baseurl, plan[0].invitation, plan[0].strategy) == (
        "https://api2.openreview.net", "ICLR.cc/2024/Conference/-/Submission", "venueid",
    )
    assert (plan[23].baseurl, plan[23].invitation, plan[23].strategy) == (
        "https://api.openreview.net", "ICLR.cc/2024/conference/-/Blind_Submission", "all",
    )


def test_last_errors(spark):
    rows = [("A", 2024, i, f"e{i}") for i in range(30)] + [("B", 2024, 5, "only")]
    got = {r.conf: r.error for r in landing.last_errors(spark.createDataFrame(rows, "conf string, year int, attempt bigint, error string")).collect()}
    assert got == {"A": "\n".join(f"e{i}" for i in range(18, 30)), "B": "only"}


def test_running_number_replaces_a_missing_note_id(spark):
    rows = [
        (conf, year, offset, position, None if (position + offset // 1000) % 3 == 0 else f"n{position}", "t", "a")
        for conf in ("A", "B")
        for year in (2023, 2024)
        for offset in (0, 1000, 2000)
        for position in range(4)
    ]
    schema = "conf string, year int, offset bigint, position int, note_id string, title string, abstract string"
    shuffled = spark.createDataFrame(rows[::-1], schema)
    got = {r.id for r in landing.paper_ids(shuffled).collect()}
    assert got == {f"{c}_{y}_{i if note is None else note}" for i, (c, y, _, _, note, _, _) in enumerate(rows)}
    assert landing.paper_ids(shuffled).count() == len(rows)


def test_running_numbers_follow_the_order_of_the_request(spark, monkeypatch):
    """As the papers of one pair after the other would be counted; blocks of any size give the same."""
    asked = [("B", 2024), ("A", 2024), ("B", 2023), ("A", 2023), ("B", 2024)]
    rows = [(conf, year, offset, k, None, "t", "a") for conf, year in dict.fromkeys(asked) for offset in (0, 1000) for k in range(3)]
    df = spark.createDataFrame(rows[::-1], "conf string, year int, offset bigint, position int, note_id string, title string, abstract string")
    pairs = spark.createDataFrame([(c, y, k) for k, (c, y) in enumerate(asked)], "conf string, year int, ordinal long")
    want = {f"{c}_{y}_{k}" for k, (c, y, *_) in enumerate(rows)}
    for block in (1, 2, 1000):
        monkeypatch.setattr(landing, "PAIRS_PER_BLOCK", block)
        ids = landing.paper_ids(df, pairs)
        assert {r.id for r in ids.collect()} == want


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def exchanged(df):
    return [part for part in plan_of(df).split("\n\n") if ") Exchange" in part or ") Sort" in part]


def test_payloads_neither_move_nor_are_sorted(spark):
    rows = [("A", 2024, 1, 1000 * k, listing(2, venue="Accept")) for k in range(5)] + [("A", 2024, 1, 5000, listing(0))]
    df = pages(spark, rows)
    summary = landing.page_summary(df)
    winners = landing.first_success(landing.candidate_counts(summary))
    for result in (landing.accepted_notes(df, winners, summary=summary), landing.pages_until_empty(df), summary):
        assert not any("payload" in part or "body" in part for part in exchanged(result))
    assert landing.pages_until_empty(df).count() == 5


def test_one_landing_of_each_page_counts(spark):
    first, second = listing(2, venue="Accept"), listing(3, venue="Accept")
    rows = [("A", 2024, 1, 0, first), ("A", 2024, 1, 0, first), ("A", 2024, 1, 0, second), ("A", 2024, 1, 1000, first), ("A", 2024, 1, 2000, listing(0))]
    df = pages(spark, rows)
    kept = landing.pages_until_empty(df)
    assert sorted(r.offset for r in kept.collect()) == [0, 1000]
    sizes = {r.offset: r.n for r in landing.page_sizes(kept).collect()}
    summary = {r.offset: (r.n, r.landings) for r in landing.page_summary(df).collect()}
    assert summary[0] == (sizes[0], 3) and summary[1000] == (2, 1)
    winners = landing.first_success(landing.candidate_counts(landing.page_summary(df)))
    assert landing.accepted_notes(df, winners).count() == sizes[0] + 2 == winners.first().accepted
